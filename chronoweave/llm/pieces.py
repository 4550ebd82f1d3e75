"""Piece models: an Aho-Corasick automaton over the pieces drives one dynamic programme per chunk of text.

For each position the automaton's state names the longest piece that ends there and its output links name
the shorter ones. The programme follows them and relaxes the best way to reach the position:

* a *unigram* model keeps the largest sum of piece scores (Viterbi);
* a *BPE* model ranks merges instead of scoring segmentations, so the largest sum isn't what its library
  returns. There a piece may relax a position only if the boundary to the piece before it is stable, i.e.
  merging the two pieces' characters by rank gives the two pieces again. A sequence of pieces is the
  result of merging exactly if all its neighbours are stable, and every prefix has one such sequence, so
  the programme yields the library's pieces, and its count for every prefix, in a single pass.

Texts are cut into chunks where no piece can span, i.e. between characters that no piece has side by side, so
chunks can be solved once and remembered.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
START = -1
#: Chunks longer than this are solved anew each time.
REMEMBERED_LENGTH = 64
#: Chunks remembered by a worker in each of two generations.
REMEMBERED_CHUNKS = 150_000
#: Stable and unstable pairs remembered by a worker.
REMEMBERED_PAIRS = 400_000
#: A character outside the pieces costs a unigram model its smallest score and this much more.
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0], at + size
        yield key >> 3, value


class Remembered(dict):
    """Results of ``solve`` by chunk, in two generations of bounded size."""

    def __init__(self, solve: Callable[[str], object], room: int = REMEMBERED_CHUNKS):
        super().__init__()
        self._solve, self._room, self._older = solve, room, {}

    def __missing__(self, chunk: str):
        if len(chunk) > REMEMBERED_LENGTH:
            return self._solve(chunk)
        found = self._older.get(chunk)
        if found is None:
            found = self._solve(chunk)
        if len(self) >= self._room:
            self._older = dict(self)
            self.clear()
        self[chunk] = found
        return found


def _chunk_pattern(longer: list[str]) -> re.Pattern | None:
    """Cuts marked text where no piece has the two characters beside each other; None if spaces end no chunk.

    Characters that pieces ever have side by side form a family; a chunk is a run of one family, with the
    spaces before it, or one character outside all families.
    """
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
        return None
    head: dict[str, str] = {}

    def find(c: str) -> str:
        while head[c] != c:
            head[c] = head[head[c]]
            c = head[c]
        return c

    for piece in longer:
        inner = piece.lstrip(SPACE)
        for a, b in zip(inner, inner[1:], strict=False):
            for c in (a, b):
                head.setdefault(c, c)
            head[find(a)] = find(b)
    families: dict[str, list[str]] = {}
    for c in sorted(head):
        families.setdefault(find(c), []).append(re.escape(c))
    runs = [f"{SPACE}*[{''.join(f)}]+" for f in sorted(families.values(), key=len, reverse=True)]
    return re.compile("|".join([*runs, f"{SPACE}*[^{SPACE}]", f"{SPACE}+"]))


class PieceModel:
    """Pieces of a ``.model`` file, or a table of (piece, score, type) rows; see the module's text."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, prefix: bool = True):
        self.pieces, self.bpe, self.prefix = pieces, bpe, prefix
        self._ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("models with user-defined symbols aren't supported")
        self._bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self._unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self._floor = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        longer = [p for p in self._ids if len(p) > 1]
        self._chunks = _chunk_pattern(longer)
        self._rank = {p: (-pieces[i][1], i) for p, i in self._ids.items()}
        self._texts = [p for p, _, _ in pieces]
        self._stable: dict[tuple[int, int], bool] = {}
        self._plain = [self._plain_bytes(p, kind) for p, _, kind in pieces]
        self._automaton = ahocorasick.Automaton()
        for p, i in self._ids.items():
            self._automaton.add_word(p, (i, len(p)))
        if self._ids:
            self._automaton.make_automaton()
        self._solved = Remembered(lambda chunk: array("i", self._encode_chunk(chunk)).tobytes())
        self._counted = Remembered(lambda chunk: self._solve(chunk)[1][-1])

    @classmethod
    def parse(cls, raw: bytes) -> PieceModel:
        """The model in the bytes of a ``.model`` file."""
        pieces, bpe, prefix, folds = [], False, True, b""
        for number, value in _fields(raw):
            if number == 1:
                row = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                pieces.append((row[1].decode(), row[2], row[3]))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                prefix, folds = bool(spec.get(3, 1)), spec.get(2, b"")
                if folds or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave texts as they are (but for the space mark) are supported")
        return cls(pieces, bpe, prefix)

    @staticmethod
    def _plain_bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def chunks(self, text: str) -> list[str]:
        """The marked text (spaces as U+2581, one before it) in pieces that no model piece spans."""
        if not text:
            return []
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return self._chunks.findall(marked) if self._chunks else [marked]

    def _text(self, piece: int) -> str:
        return self._texts[piece] if piece >= 0 else chr(-2 - piece)

    def _is_stable(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces by rank gives these two pieces."""
        known = self._stable.get((left, right))
        if known is None:
            known = self._merge_keeps(self._text(left), self._text(right))
            if len(self._stable) >= REMEMBERED_PAIRS:
                self._stable.clear()
            self._stable[left, right] = known
        return known

    def _merge_keeps(self, left: str, right: str) -> bool:
        parts, edge = [*left, *right], len(left)  # edge: the parts of left
        rank = self._rank.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = rank(parts[i] + parts[i + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                return edge == 1 and len(parts) == 2
            if at == edge - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            edge -= at < edge

    def _solve(self, chunk: str) -> tuple[list[int], list[int]]:
        """For each prefix of the chunk its last piece and its number of tokens."""
        size = len(chunk)
        last: list[int | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        last[0] = START
        done = 0
        if self.bpe:
            stable = self._stable.get
            for end, (piece, length) in self._automaton.iter(chunk) if self._ids else ():
                end += 1
                while done < end - 1:
                    done += 1
                    if last[done] is None:
                        self._foreign(chunk, done, last, count)
                if last[end] is not None:
                    continue
                before = last[end - length]
                if before != START:
                    known = stable((before, piece))
                    if known is None:
                        known = self._is_stable(before, piece)
                    if not known:
                        continue
                last[end], count[end] = piece, count[end - length] + 1
            while done < size:
                done += 1
                if last[done] is None:
                    self._foreign(chunk, done, last, count)
            return last, count
        best = [0.0] * (size + 1)
        ways: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for end, (piece, length) in self._automaton.iter(chunk) if self._ids else ():
            ways[end + 1].append((piece, length))
        for end in range(1, size + 1):
            top = None
            for piece, length in ways[end]:
                score = best[end - length] + self.pieces[piece][1]
                if top is None or score > top:
                    top, last[end], count[end] = score, piece, count[end - length] + 1
            if not any(length == 1 for _, length in ways[end]) and (top is None or best[end - 1] + self._floor > top):
                top = best[end - 1] + self._floor
                self._foreign(chunk, end, last, count)
            best[end] = top
        return last, count

    def _foreign(self, chunk: str, end: int, last: list, count: list) -> None:
        """The character before ``end`` is no piece: its bytes stand for it (or the unknown piece)."""
        char = chunk[end - 1]
        last[end] = -2 - ord(char)
        count[end] = count[end - 1] + (len(char.encode()) if self._bytes else 1)

    def _encode_chunk(self, chunk: str) -> list[int]:
        last, _ = self._solve(chunk)
        out: list[int] = []
        at = len(chunk)
        while at:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= len(self._texts[piece])
            else:
                raw = chunk[at - 1].encode()
                out.extend([self._bytes[b] for b in reversed(raw)] if self._bytes else [self._unknown])
                at -= 1
        return out[::-1]

    def encode_bytes(self, text: str | None) -> bytes:
        """Piece ids of a text as native 32-bit integers; none for an empty or missing text."""
        return b"".join(map(self._solved.__getitem__, self.chunks(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.encode_bytes(text)))

    def decode(self, ids) -> str:
        """The text of the pieces; U+2581 comes back as a space, byte runs that are no UTF-8 as U+FFFD."""
        raw = b"".join(map(self._plain.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")

    def count(self, text: str | None) -> int:
        return sum(map(self._counted.__getitem__, self.chunks(text or "")))

    def prefix_counts(self, text: str | None) -> array:
        """Tokens of ``text[:i]`` for every i from 0 to the text's length."""
        out = array("i", [0])
        base = 0
        for number, chunk in enumerate(self.chunks(text or "")):
            counts = self._solve(chunk)[1]
            skip = 2 if self.prefix and number == 0 else 1  # the mark before the text is no prefix of it
            out.extend(base + c for c in counts[skip:])
            base += counts[-1]
        return out

    def fit(self, text: str | None, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens (counts can fall as a prefix grows)."""
        if not text or budget <= 0:
            return 0
        chunks = self.chunks(text)
        ends = list(accumulate(map(self._counted.__getitem__, chunks)))
        if ends[-1] <= budget:
            return len(text)
        low, high = 0, len(chunks) - 1  # the last chunk that begins with tokens left
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if ends[mid - 1] < budget else (low, mid - 1)
        base = ends[low - 1] if low else 0
        counts = self._solve(chunks[low])[1]
        inside = max((i for i in range(1, len(counts)) if base + counts[i] <= budget), default=0)
        return max(0, sum(map(len, chunks[:low])) + inside - bool(self.prefix))


_LOADED: dict[tuple[int, int], PieceModel] = {}


def loaded(raw: bytes) -> PieceModel:
    """The model of these bytes, built once in each worker."""
    key = (len(raw), hash(raw))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel.parse(raw)
    return _LOADED[key]


#: Largest model file that is sent to the executors.
MAX_MODEL_BYTES = 64 << 20


def read_model(path: str) -> bytes:
    """The bytes of a model file, whose size is checked as they go to every executor."""
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return raw
