"""Merges of a byte-level vocabulary as a transducer over bytes that is made deterministic while it runs."""

from __future__ import annotations

import base64

#: States that a transducer remembers; beyond that it forgets them and goes on.
STATES = 200_000
#: Judged pairs of tokens that it remembers.
PAIRS = 1_000_000
#: Bytes after which the certain tokens of a long piece are emitted.
HELD = 1 << 12
#: No token before this place.
NOTHING = -1
#: Higher than any rank.
NO_RANK = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines with base64 text and number."""
    with open(path, "rb") as lines:
        cells = (line.split() for line in lines)
        return {base64.b64decode(c[0]): int(c[1]) for c in cells if c}


class Transducer:
    """Reads bytes one by one and emits tokens as soon as no continuation can change them.

    Ranked merging has two properties that make this possible.  A sequence of tokens is the encoding of its bytes
    exactly if each token encodes to itself and so does each pair of neighbours; and the encoding of a text without its
    last token is the encoding of that shorter text.  So every prefix of the input has one last token, the one that goes
    with the last token of the prefix before it, and prefixes form a tree.

    A state holds the places where a token may begin that reaches beyond what was read: for each the bytes since and the
    last token before it, and at last the present end.  A byte leads to the next state and to the last token of the new
    prefix.  There is no more to know, so runs that differ in earlier bytes meet in one state.  The bytes of a state are
    the beginning of one token, so states are finite in number; they and their transitions are made when first reached
    and kept.  Tokens that the ways back from all places of a state have in common are certain; lookahead is bounded by
    the vocabulary.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        #: Beginnings of tokens, each by itself, so that states share them.
        self.openings = {t[:n]: t[:n] for t in ranks for n in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: Next state and last token by state and byte, in one number.
        self.steps: dict[int, tuple[int, int]] = {}
        self._number(((b"", NOTHING),))

    def _number(self, places: tuple) -> int:
        number = self.numbers.setdefault(places, len(self.states))
        if number == len(self.states):
            self.states.append(places)
        return number

    def merged(self, data: bytes) -> list[int]:
        """Ids by the definition: of all neighbours that join to a token, the first with the lowest rank join."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while joined:
            least = min(joined)
            if least == NO_RANK:
                break
            at = joined.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], NO_RANK)
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _stays(self, left: int, right: int) -> bool:
        """Whether the right token, and the left one before it if there is one, come out of merging as they are."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            both = [right] if left == NOTHING else [left, right]
            known = self.merged(b"".join([self.text[t] for t in both])) == both
            if known and left != NOTHING:
                known = self._stays(NOTHING, left) and self._stays(NOTHING, right)
            self.pairs[left, right] = known
        return known

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        last, places, byte_ = NOTHING, [], bytes([byte])
        for since, before in self.states[number]:
            now = since + byte_
            if last == NOTHING:
                own = self.ranks.get(now, NOTHING)
                if own != NOTHING and self._stays(before, own):
                    last = own
            opening = self.openings.get(now)
            if opening is not None:
                places.append((opening, before))
        places.append((b"", last))
        found = self.steps[number << 8 | byte] = self._number(tuple(places)), last
        return found

    def _emit(self, lasts: list[int], place: int) -> list[int]:
        """Tokens on the way back from a place, first one first."""
        out = []
        while place:
            out.append(lasts[place])
            place -= len(self.text[lasts[place]])
        return out[::-1]

    def _certain(self, lasts: list[int], state: int) -> int:
        """The last place that the ways back from all places of the state share."""
        end = len(lasts) - 1
        open_ = {end - len(since) for since, _ in self.states[state]}
        while len(open_) > 1:
            place = max(open_)
            open_.remove(place)
            open_.add(place - len(self.text[lasts[place]]))
        return open_.pop()

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece.  A piece that is a token has its id, also if merging would not lead to it."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self._forget()
        known, state, out, lasts = self.steps.get, 0, [], [NOTHING]
        for byte in data:
            found = known(state << 8 | byte)
            state, last = found if found is not None else self._step(state, byte)
            lasts.append(last)
            if len(lasts) > HELD:
                certain = self._certain(lasts, state)
                out += self._emit(lasts, certain)
                lasts = lasts[certain:]
        return out + self._emit(lasts, len(lasts) - 1)
