"""Bytes that come in parts as text: a state machine over UTF-8, lifted to whole tokens."""

from __future__ import annotations

import numpy as np

#: Well-formed sequences (Unicode standard, table 3-7): first bytes, then the ranges of the bytes that follow.
SEQUENCES = [
    ((0x00, 0x7F),),
    ((0xC2, 0xDF), (0x80, 0xBF)),
    ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)),
    ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)),
    ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
]
START, REFUSED = 0, -1
REPLACEMENT = "\N{REPLACEMENT CHARACTER}".encode()


def _machine() -> list[list[int]]:
    """State after each byte: ``START`` between characters, a state for each list of ranges still to come."""
    numbers: dict[tuple, int] = {(): START}
    rows: list[list[int]] = []
    waiting: list[tuple] = [()]
    while len(rows) < len(waiting):
        rest = waiting[len(rows)]
        row = [REFUSED] * 256
        for sequence in SEQUENCES if not rest else [rest]:
            after = sequence[1:]
            if after not in numbers:
                numbers[after] = len(waiting)
                waiting.append(after)
            for byte in range(sequence[0][0], sequence[0][1] + 1):
                row[byte] = numbers[after]
        rows.append(row)
    return rows


MACHINE = _machine()


class Utf8:
    """Takes bytes in any parts and gives whole characters; what is no character becomes U+FFFD, one for each longest
    beginning of a character, as decoders agree to do."""

    def __init__(self) -> None:
        self.state = START
        self.open = bytearray()

    def feed(self, data: bytes) -> bytes:
        """The characters that end in ``data``, as UTF-8; a begun one stays open."""
        out, state, open_ = bytearray(), self.state, self.open
        for byte in data:
            after = MACHINE[state][byte]
            if after == REFUSED and state != START:
                out += REPLACEMENT  # the open bytes; this one may begin a character
                open_.clear()
                state = START
                after = MACHINE[START][byte]
            if after == REFUSED:
                out += REPLACEMENT
                continue
            open_.append(byte)
            if after == START:
                out += open_
                open_.clear()
            state = after
        self.state = state
        return bytes(out)

    def close(self) -> bytes:
        """What an open character at the end stands for."""
        out = REPLACEMENT if self.open else b""
        self.state = START
        self.open.clear()
        return out


class TokenText:
    """Ids to UTF-8 text, some ids at a time.

    For each token it is known whether it begins and ends between characters; runs of such tokens pass whole, and only
    the tokens around a character that is split over tokens go through the machine byte by byte.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        size = max(tokens, default=-1) + 2
        texts = [tokens.get(i, REPLACEMENT) for i in range(size)]  # the last place stands for ids without token
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.whole = np.array([self._is_whole(t) for t in texts], bool)

    @staticmethod
    def _is_whole(text: bytes) -> bool:
        state = START
        for byte in text:
            state = MACHINE[state][byte]
            if state == REFUSED:
                return False
        return state == START

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.places[ids] - (ends - sizes), sizes)
        return self.bytes[flat].tobytes()

    def feed(self, ids: np.ndarray, reader: Utf8) -> bytes:
        """Text that the ids complete; ``reader`` holds a character that is not complete yet.

        Only bytes after the last whole character have to be kept, so the machine runs over these; where the bytes
        before are not well-formed, it runs over all.
        """
        ids = np.minimum(ids.astype(np.int64), len(self.sizes) - 1)
        data = bytes(reader.open) + self.joined(ids)
        if reader.state == START and self.whole[ids].all():
            return data
        reader.close()
        begin = next((k for k in range(len(data) - 1, max(-1, len(data) - 4), -1) if data[k] & 0xC0 != 0x80), 0)
        try:
            data[:begin].decode()
        except UnicodeDecodeError:
            begin = 0
        return data[:begin] + reader.feed(data[begin:])
