"""Cheapest edit scripts that repair the order of roles, as shared, linked letters.

A repaired conversation reads (s?(ua)+)? in the initials of its roles, so four states
tell how far it is: nothing yet, behind a system row, behind a user row, behind an
assistant row. In every state the search keeps one script: the cheapest, and of equally
cheap ones the ASCII-least. That is enough, since a script's letters determine the
states it passes, and of two equally cheap scripts for the same rows and state none can
begin the other (it would go on with insertions only, which cost).

Scripts share their beginnings: a script is its last letter, linked to the script
before it, with links to its ancestors 1, 2, 4, ... letters back and a rolling hash
of all its letters. Ties go to the script whose letter is less behind the longest common
beginning, which a binary search over the ancestors finds by comparing hashes. Every
hash is entered once with the letter and hash it stands for; a collision moves to the
next free number, so equal hashes always mean equal scripts.
"""

from __future__ import annotations

OTHER, SYSTEM, USER, ASSISTANT = range(4)   # what a role begins with
ROLE, BLANK, TRUNCATED, DUPLICATE = 3, 4, 8, 16  # bits of a row's code
DELETED = BLANK | DUPLICATE

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is for truncated rows that stay
BASE, PRIME = 0x1F35A7BD3C91, (1 << 61) - 1
NEVER = 1 << 60

AFTER_USER, AFTER_ASSISTANT = 2, 3
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)  # where a rerole or an insertion leads
#: What a state still needs at the end of a conversation.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def kept_state(state: int, role: int) -> int | None:
    """The state behind a kept row, if the row may stand there."""
    if role == SYSTEM:
        return 1 if state == 0 else None
    if role == USER:
        return AFTER_USER if state != AFTER_USER else None
    return AFTER_ASSISTANT if role == ASSISTANT and state == AFTER_USER else None


class Scripts:
    """Linked letters; 0 is the empty script."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.letter, self.hash, self.size, self.up = [""], [0], [0], [()]
        self.stands_for = {0: (0, "")}

    def add(self, script: int, letter: str) -> int:
        means = (self.hash[script], letter)
        value = (means[0] * BASE + ord(letter)) % self.prime
        while self.stands_for.setdefault(value, means) != means:
            value += 1
        up = [script]
        while len(far := self.up[up[-1]]) >= len(up):
            up.append(far[len(up) - 1])
        self.letter.append(letter)
        self.hash.append(value)
        self.size.append(self.size[script] + 1)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def _back(self, script: int, letters: int) -> int:
        while letters:
            step = letters.bit_length() - 1
            script, letters = self.up[script][step], letters - (1 << step)
        return script

    def less(self, a: int, b: int) -> bool:
        """ASCII order; a script comes before those it begins."""
        short = min(self.size[a], self.size[b])
        x, y = self._back(a, self.size[a] - short), self._back(b, self.size[b] - short)
        if self.hash[x] == self.hash[y]:
            return self.size[a] < self.size[b]
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, script: int) -> str:
        out = []
        while script:
            out.append(self.letter[script])
            script = self.up[script][0]
        return "".join(reversed(out))


class _Search:
    """Best (cost, script) of every state, a row at a time."""

    def __init__(self, start: int):
        self.scripts = Scripts()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[start] = (0, 0)

    def _offer(self, table: list, state: int, cost: int, script: int, letter: str) -> None:
        held = table[state]
        if held is not None and held[0] < cost:
            return
        new = self.scripts.add(script, letter)
        if held is None or cost < held[0] or self.scripts.less(new, held[1]):
            table[state] = (cost, new)

    def _inserted(self) -> list:
        """At most two insertions in a row: three lead where one leads."""
        table = self.best
        for _ in range(2):
            wider = list(table)
            for state, held in enumerate(table):
                if held is not None:
                    self._offer(wider, NEXT[state], held[0] + INSERT, held[1], "I")
            table = wider
        return table

    def read(self, code: int) -> None:
        table: list = [None] * 4
        stays, extra = not code & DELETED, CUT if code & TRUNCATED else 0
        for state, held in enumerate(self._inserted()):
            if held is None:
                continue
            cost, script = held
            self._offer(table, state, cost + DELETE, script, "D")
            if stays:
                kept = kept_state(state, code & ROLE)
                if kept is not None:
                    self._offer(table, kept, cost + KEEP + extra, script, "K")
                if kept != NEXT[state]:
                    self._offer(table, NEXT[state], cost + REROLE + extra, script, "R")
        self.best = table


def cheapest(codes: bytes, start: int = 0, ends: list[int] | None = None) -> tuple[int, str, int]:
    """Cost and letters of the cheapest script for rows, and the state behind it.

    ``ends`` are the costs of what follows each state in later rows; None: these
    are the last rows, and the conversation must be complete.
    """
    search = _Search(start)
    for code in codes:
        search.read(code)
    found: list = [None]  # one winner over all states
    state_of = {}
    for state, held in enumerate(search.best):
        if held is None:
            continue
        cost, script = held
        if ends is None:
            more, letters = ENDS[state]
            for letter in letters:
                script = search.scripts.add(script, letter)
        else:
            more = ends[state]
        state_of[script] = state
        total = cost + more
        if found[0] is None or total < found[0][0] or (total == found[0][0] and search.scripts.less(script, found[0][1])):
            found[0] = (total, script)
    total, script = found[0]
    state = state_of[script]
    return total - (0 if ends is None else ends[state]), search.scripts.text(script), state


def costs(codes: bytes) -> list[int]:
    """Cheapest costs from each state to each state over rows, 16 numbers."""
    out = []
    for start in range(4):
        best = [NEVER] * 4
        best[start] = 0
        for code in codes:
            for _ in range(2):
                q0, q1, q2, q3 = best
                best = [q0, q1, min(q2, q0 + INSERT, q1 + INSERT, q3 + INSERT), min(q3, q2 + INSERT)]
            after = [c + DELETE for c in best]
            if not code & DELETED:
                extra = CUT if code & TRUNCATED else 0
                for state, cost in enumerate(best):
                    kept = kept_state(state, code & ROLE)
                    if kept is not None:
                        after[kept] = min(after[kept], cost + extra)
                    after[NEXT[state]] = min(after[NEXT[state]], cost + REROLE + extra)
            best = after
        out.extend(min(c, NEVER) for c in best)
    return out


def ends_before(matrix: list[int], ends: list[int]) -> list[int]:
    """Costs of all that follows each state at the start of rows, given those at their end."""
    return [min(matrix[4 * start + state] + ends[state] for state in range(4)) for start in range(4)]


def repaired(rows: list[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """``role:text`` of the rows a script leaves, from the state it starts in."""
    out, at = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            state = kept_state(state, initial(role))
        else:
            role, state = "user" if NEXT[state] == AFTER_USER else "assistant", NEXT[state]
        out.append(f"{role}:{text}")
    return out


def initial(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
