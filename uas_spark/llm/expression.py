"""Union-free regular expressions over sibling labels, and their alignment (helper of operator 11).

An expression is a sequence of groups; a group holds items and is read once or, if repeated, again
and again; an item may be optional and may follow itself. A label stands in one group only, so
an expression is never longer than the labels it knows. Reading a label that has been read
before closes a square: everything since then becomes one repeated group.
"""

from __future__ import annotations


class Chain:
    """``groups``: [labels, repeated]; ``marks``: label -> [group, optional, many]."""

    __slots__ = ("groups", "marks", "at")

    def __init__(self) -> None:
        self.groups: list[list] = []
        self.marks: dict[str, list] = {}
        self.at = -1  # place of the last label read, within the last group

    def push(self, label: str) -> Chain:
        """Read one more label of the same element."""
        mark = self.marks.get(label)
        if mark is None:
            self._leave()
            self.groups.append([[label], False])
            self.marks[label] = [len(self.groups) - 1, False, False]
            self.at = 0
            return self
        if mark[0] < len(self.groups) - 1 or len(self.groups[mark[0]][0]) == 1:
            if mark[0] == len(self.groups) - 1:
                mark[2] = True  # a label that follows itself
                return self
            self._leave()
            self._fold(mark[0])
            self.at = -1
        labels = self.groups[-1][0]
        here = labels.index(label)
        if here == self.at:
            mark[2] = True
        elif here > self.at:
            self._skip(labels[self.at + 1:here])
        else:  # a new round of the group
            self._skip(labels[self.at + 1:])
            self._skip(labels[:here])
        self.at = here
        return self

    def _skip(self, labels: list[str]) -> None:
        for x in labels:
            self.marks[x][1] = True

    def _leave(self) -> None:
        """The last group ends here: what its last round lacked is optional."""
        if self.groups and self.at >= 0:
            self._skip(self.groups[-1][0][self.at + 1:])

    def _fold(self, first: int) -> None:
        """Groups from ``first`` on become one repeated group.

        Beside a part that was itself repeated, the other labels are optional: its rounds lack them.
        """
        rounds = [g for g in self.groups[first:] if g[1]]
        for g in self.groups[first:]:
            if any(r is not g for r in rounds):
                self._skip(g[0])
        labels = [x for g in self.groups[first:] for x in g[0]]
        self.groups[first:] = [[labels, True]]
        for x in labels:
            self.marks[x][0] = first

    def close(self) -> Chain:
        self._leave()
        self.at = -1
        return self

    def many(self, label: str) -> bool:
        """Whether the label can occur more than once."""
        group, _, many = self.marks[label]
        return many or self.groups[group][1]

    def __str__(self) -> str:
        out = []
        for labels, repeated in self.groups:
            items = [x + ("*" if self.marks[x][1] and self.marks[x][2] else "?" if self.marks[x][1]
                          else "+" if self.marks[x][2] else "") for x in labels]
            out.append(f"( {' '.join(items)} )+" if repeated else " ".join(items))
        return " ".join(out)


def parse(text: str) -> Chain:
    """The expression that ``str`` wrote."""
    c, inside = Chain(), False
    for token in text.split():
        if token == "(":
            c.groups.append([[], True])
            inside = True
        elif token == ")+":
            inside = False
        else:
            label = token.rstrip("?*+")
            if not inside:
                c.groups.append([[], False])
            c.groups[-1][0].append(label)
            c.marks[label] = [len(c.groups) - 1, token[-1] in "?*", token[-1] in "+*"]
    return c


def align(a: Chain, b: Chain) -> Chain:
    """The expression that reads whatever ``a`` or ``b`` reads.

    Both are walked from left to right. Heads that share a label become one group (of
    optional labels, read again and again, where the two are not alike). At a mismatch
    the head that the other side does not hold further on is optional; if both sides hold the
    other's head, the order differs, and meeting the label again folds the stretch between into
    a repeated group.
    """
    out = Chain()

    def add(labels: list[str], repeated: bool, side: Chain, optional: bool, mixed: bool) -> None:
        """Put one group at the end; ``mixed``: its labels may come in any order and number."""
        seen = [out.marks[x][0] for x in labels if x in out.marks]
        if seen:
            out._fold(min(seen))
            mixed = True
        else:
            out.groups.append([[], repeated])
        group = out.groups[-1]
        group[1] = group[1] or repeated or mixed
        for x in labels:
            _, opt, many = side.marks[x]
            if x not in out.marks:
                group[0].append(x)
                out.marks[x] = [len(out.groups) - 1, False, False]
            mark = out.marks[x]
            mark[1], mark[2] = mark[1] or opt or optional, mark[2] or many
        if mixed:
            out._skip(group[0])

    i = j = 0
    while i < len(a.groups) or j < len(b.groups):
        ga = a.groups[i] if i < len(a.groups) else None
        gb = b.groups[j] if j < len(b.groups) else None
        if ga and gb and not set(ga[0]).isdisjoint(gb[0]):
            same = ga[0] == gb[0]
            add(ga[0], ga[1] or (same and gb[1]), a, False, not same)
            for x in gb[0]:
                if x in ga[0]:
                    mark = out.marks[x]
                    mark[1], mark[2] = mark[1] or b.marks[x][1], mark[2] or b.marks[x][2]
            extra = [x for x in gb[0] if x not in ga[0]]
            if extra:
                out.groups[-1][0] += [x for x in extra if x not in out.marks]
                for x in extra:
                    out.marks.setdefault(x, [len(out.groups) - 1, True, b.marks[x][2]])
                first = min(out.marks[x][0] for x in extra)
                if first < len(out.groups) - 1:
                    out._fold(first)
                for x in extra:
                    out.marks[x][2] = out.marks[x][2] or b.marks[x][2]
                out._skip(out.groups[-1][0])
            i, j = i + 1, j + 1
            continue
        b_knows = ga is not None and any(b.marks[x][0] >= j for x in ga[0] if x in b.marks)
        a_knows = gb is not None and any(a.marks[x][0] >= i for x in gb[0] if x in a.marks)
        if gb is not None and (ga is None or (b_knows and not a_knows)):
            add(gb[0], gb[1], b, True, False)
            j += 1
        else:
            add(ga[0], ga[1], a, True, False)
            i += 1
    return out
