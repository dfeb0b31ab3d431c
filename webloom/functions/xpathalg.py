"""XPaths that can be refined: immutable versions of a root-to-node path, finer and coarser by single steps.

A path is a tuple of tags from the root to the node; a tag has a use flag and attributes, each shown not at all (0),
by name (1) or by name and value (2). Steps give new paths; nothing is changed in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Attribute:
    name: str
    value: str
    flag: int = 0

    def render(self) -> str:
        return ("", f"@{self.name}", f'@{self.name}="{self.value}"')[self.flag]


@dataclass(frozen=True)
class Tag:
    name: str
    attributes: tuple[Attribute, ...] = ()
    use: bool = True
    target: bool = False

    def render(self) -> str:
        if not self.use:
            return ""
        shown = " and ".join(a.render() for a in self.attributes if a.flag)
        return f"{self.name}[{shown}]" if shown else self.name

    def finer(self) -> Tag | None:
        if not self.use:
            return replace(self, use=True)
        for k, a in enumerate(self.attributes):
            if a.flag < 2:
                return self._with(k, a.flag + 1)
        return None

    def coarser(self) -> Tag | None:
        for k in range(len(self.attributes) - 1, -1, -1):
            if self.attributes[k].flag:
                return self._with(k, self.attributes[k].flag - 1)
        return replace(self, use=False) if self.use and not self.target else None

    def _with(self, k: int, flag: int) -> Tag:
        return replace(self, attributes=(*self.attributes[:k], replace(self.attributes[k], flag=flag), *self.attributes[k + 1 :]))

    def all_at(self, flag: int) -> Tag:
        return replace(self, attributes=tuple(replace(a, flag=flag) for a in self.attributes))


Path = tuple[Tag, ...]


def render(path: Path) -> str:
    raw = "/" + "".join(t.render() + "/" for t in path)
    return re.sub("/$", "", re.sub("///+", "//", raw, count=1))


def default_path(chain: list[tuple[str, list[tuple[str, str]]]]) -> Path:
    """The default version for a node given with its ancestors, root first: (name, attributes) of each.

    Up to the deepest tag with an id, the node shows all its attribute names and ancestors their first; the tag with
    the id shows that name alone, and tags above it show none.
    """
    tags: list[Tag] = []
    open_ = True
    for depth, (name, attrs) in enumerate(reversed(chain)):
        target = depth == 0
        kept = [(a, v) for a, v in attrs if not target or (a != "href" and ":" not in a)]
        flags = [0] * len(kept)
        if open_:
            ids = [k for k, (a, _) in enumerate(kept) if a == "id"]
            if ids:
                flags[ids[0]] = 1
                open_ = False
            elif target:
                flags = [1] * len(kept)
            elif kept:
                flags[0] = 1
        tags.append(Tag(name, tuple(Attribute(a, v, f) for (a, v), f in zip(kept, flags, strict=True)), True, target))
    return tuple(reversed(tags))


def finer(path: Path) -> Path | None:
    """One step at the last tag that can take one."""
    for k in range(len(path) - 1, -1, -1):
        if step := path[k].finer():
            return (*path[:k], step, *path[k + 1 :])
    return None


def coarser(path: Path) -> Path | None:
    """One step at the first tag that can take one."""
    for k, tag in enumerate(path):
        if step := tag.coarser():
            return (*path[:k], step, *path[k + 1 :])
    return None


def ladder(path: Path, finer_steps: bool) -> Iterator[Path]:
    """All versions that follow, one step each."""
    step = finer if finer_steps else coarser
    while (path := step(path)) is not None:
        yield path


def finest(path: Path) -> Path:
    return tuple(replace(t.all_at(2), use=True) for t in path)


def coarsest(path: Path) -> Path:
    return tuple(replace(t.all_at(0), use=t.target) for t in path)
