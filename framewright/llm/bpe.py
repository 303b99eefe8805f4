"""Byte-level BPE as a finite-state transducer.

A state is the run of bytes since the last boundary that no continuation can
move. Reading a byte, the transducer finds the last token of every prefix (the
one that BPE would end with), follows these back from each place where a token
that is not yet complete may start, and emits the tokens on the stretch that all
of them share. States and transitions are built as they are met, and kept. How
far it looks ahead is bounded by the longest token.
"""

from __future__ import annotations

from base64 import b64decode

#: States that a worker keeps before it starts anew; results don't depend on it.
MAX_STATES = 200_000
#: Pieces whose ids a worker keeps, of no more than KEPT_CHARS.
MAX_PIECES, KEPT_CHARS = 400_000, 200


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}
        self.pending: list[bytes] = [b""]
        self.starts: list[tuple[int, ...]] = [()]  # for each prefix of pending, where its last token starts
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        self.finals: list[bytes | None] = [b""]

    def _restart(self, state: int) -> int:
        """Forget all states but this one; its new number."""
        text, starts = self.pending[state], self.starts[state]
        self._reset()
        return self._number(text, starts) if text else 0

    def _number(self, text: bytes, starts: tuple[int, ...]) -> int:
        number = self.numbers.get(text)
        if number is None:
            number = self.numbers[text] = len(self.pending)
            self.pending.append(text)
            self.starts.append(starts)
            self.moves.append({})
            self.finals.append(None)
        return number

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """Merge neighbours by rank until none is left: how the merges are compiled."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts = parts[:at] + [parts[at] + parts[at + 1]] + parts[at + 2 :]
        return parts

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Is left, right what BPE makes of their bytes?"""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 2 * MAX_STATES:
                self.pairs.clear()
            found = self.pairs[left, right] = self._merged([bytes([b]) for b in left + right]) == [left, right]
        return found

    def _is_token(self, token: bytes) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self._merged([bytes([b]) for b in token]) == [token]
        return found

    def _last_start(self, text: bytes, starts: tuple[int, ...]) -> int:
        """Where the last token of text starts, given the same for its proper prefixes."""
        n = len(text)
        for j in range(max(0, n - self.longest), n):
            token = text[j:]
            if token in self.ranks and (self._stays(text[starts[j - 1] : j], token) if j else self._is_token(token)):
                return j
        raise ValueError("the ranks lack a single byte")

    def _path(self, starts: tuple[int, ...], end: int) -> list[int]:
        out = []
        while end:
            out.append(end)
            end = starts[end - 1]
        return out[::-1]

    def _ids(self, text: bytes, path: list[int]) -> bytes:
        return b"".join(self.ranks[text[a:b]].to_bytes(4, "little") for a, b in zip([0, *path], path))

    def _move(self, state: int, byte: int) -> tuple[int, bytes]:
        text = self.pending[state] + bytes([byte])
        starts = (*self.starts[state], self._last_start(text, self.starts[state]))
        n = len(text)
        live = [n, *(j for j in range(max(0, n - self.longest), n) if text[j:] in self.prefixes)]
        if min(live) == 0:
            sure: list[int] = []
        else:
            paths = [self._path(starts, j) for j in live]
            shared = set(paths[0]).intersection(*paths[1:])
            sure = [p for p in paths[0] if p in shared]
        cut, out = (sure[-1], self._ids(text, sure)) if sure else (0, b"")
        number = self._number(text[cut:], tuple(s - cut for s in starts[cut:]))
        self.moves[state][byte] = number, out
        return number, out

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit bytes."""
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                if len(self.pending) > MAX_STATES:
                    state, moves = self._restart(state), self.moves
                move = self._move(state, byte)
            state, ids = move
            if ids:
                out.append(ids)
        last = self.finals[state]
        if last is None:
            text, starts = self.pending[state], self.starts[state]
            last = self.finals[state] = self._ids(text, self._path(starts, len(text)))
        out.append(last)
        return b"".join(out)


class Encoder:
    """Splits texts by a pattern and encodes each match by the transducer; pieces met before come from a store."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        known = self.known
        if len(known) > MAX_PIECES:
            known.clear()
        out = []
        # A match never spans a line break but for runs of blanks; blocks only bound the list of matches.
        for block in blocks(text):
            pieces = self.find(block)
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = self.transducer.encode(p.encode())
                    if len(p) <= KEPT_CHARS:
                        known[p] = ids
                out.append(ids)
        return b"".join(out)


def blocks(text: str, size: int = 1_000_000):
    """Texts beyond size are cut where a letter follows a blank's first character: no match of the pattern spans such a place.

    The place is before a single blank that stands between two letters or digits.
    """
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1].isalpha()):
            end += 1
        if end >= len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class StreamDecoder:
    """Ids to text as they come: bytes of a character that is not complete wait for the next call.

    The state is that of the UTF-8 automaton: continuation bytes still due and the
    range that the next one must fall in.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rest = tokens, b""

    @staticmethod
    def due(tail: bytes) -> int:
        """How many bytes at the end of tail begin a character that is not complete, 0 if none or if they can't."""
        low, high, left, begun = 0x80, 0xBF, 0, 0
        for i, b in enumerate(tail):
            if left and low <= b <= high:
                left, low, high = left - 1, 0x80, 0xBF
                continue
            left, low, high, begun = 0, 0x80, 0xBF, i
            if 0xC2 <= b <= 0xDF:
                left = 1
            elif 0xE0 <= b <= 0xEF:
                left, low, high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                left, low, high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return len(tail) - begun if left else 0

    def feed(self, ids) -> bytes:
        """The bytes of all characters that are complete; bytes that are no UTF-8 pass as they are."""
        data = self.rest + b"".join(map(self.tokens.__getitem__, ids))
        tail = data[-4:]
        first = next((i for i, b in enumerate(tail) if not 0x80 <= b <= 0xBF), len(tail))
        keep = self.due(tail[first:])
        self.rest = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep]

    def close(self) -> bytes:
        rest, self.rest = self.rest, b""
        return rest
