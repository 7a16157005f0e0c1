"""SentencePiece encoding with byte spans in the source, and decoding, for BPE models.

A model's compiled character map is a double array over the bytes of what it replaces, behind it the replacements. Text
is normalised by the longest replacement at each place; every byte of the result records where its source begins.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model is broadcast; one with more pieces is refused.
MAX_PIECES = 1_000_000
#: Encoded runs that a task remembers before it starts afresh.
REMEMBERED = 400_000
#: Bytes of runs that are merged by scanning for the best neighbours; longer ones use a heap.
SHORT = 64
NEVER = float("inf")
NO_RANK = 1 << 40
#: Rows encoded at a time.
ROWS = 256
ENCODED = "doc_id bigint, ids binary, begins binary, ends binary"

# The mark of a blank in pieces, the text of a malformed byte, and the kinds of pieces in a model file.
BLANK = "▁".encode()
MALFORMED = "�".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Longest-prefix replacement through the double array of a model file.

    A unit's lowest byte and highest bit are its label, bit 8 says that a value hangs below, bits 10 to 30 are the offset
    to its children, shifted by 8 more if bit 9 is set. The first word of the file's bytes is the length of the array.
    """

    def __init__(self, compiled: bytes = b""):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").tolist()
        self.replacements = compiled[4 + size :]

    @staticmethod
    def _below(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement; None without a key."""
        units = self.units
        if not units:
            return None
        node, found = self._below(units[0]), None
        for k in range(at, len(text)):
            byte = text[k]
            if (place := node ^ byte) >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != byte:
                break
            node = place ^ self._below(unit)
            if unit & 0x100:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, value = found
        return length, self.replacements[value : self.replacements.index(b"\0", value)]

    def has_inner(self, byte: int) -> bool:
        """Some key has ``byte`` behind its first byte."""
        if not self.units:
            return False
        units = np.array(self.units, dtype=np.int64)
        labels = np.arange(1, 256)
        nodes, first = np.array([self._below(self.units[0])]), True
        while len(nodes):
            places = nodes[:, None] ^ labels
            inside = places < len(units)
            met = inside & (units[np.where(inside, places, 0)] & 0x800000FF == labels)
            if not first and met[:, byte - 1].any():
                return True
            children = places[met]
            unit = units[children]
            nodes, first = children ^ ((unit >> 10) << np.where(unit & 0x200, 8, 0)), False
        return False


def character_length(text: bytes, at: int) -> int:
    """Bytes of the well-formed character at ``at``; 0 if there is none."""
    byte = text[at]
    n = 1 if byte < 0x80 else 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0
    try:
        return n if n and len(text[at : at + n].decode()) == 1 else 0
    except UnicodeDecodeError:
        return 0


class Pairs:
    """Merges of very many short runs at once: all pairs of symbols that join, sorted, with their symbol and rank.

    Symbols are the characters of pieces, in order, and then the longer pieces. In each round every run joins its
    best-ranked neighbours, the leftmost of equals, and only the pairs beside them are looked up again.
    """

    def __init__(self, costs: dict[str, float], numbers: dict[str, int], of_bytes: Sequence[int]):
        characters = sorted({c for p in costs for c in p})
        self.codes = np.array([ord(c) for c in characters], dtype=np.uint32)
        symbols = {c: k for k, c in enumerate(characters)}
        for piece in costs:
            symbols.setdefault(piece, len(symbols))
        rank = {cost: k for k, cost in enumerate(sorted(set(costs.values())))}
        found = [
            (symbols[a] << 32 | symbols[b], symbols[piece], rank[cost]) for piece, cost in costs.items() for k in range(1, len(piece))
            if (a := piece[:k]) in symbols and (b := piece[k:]) in symbols]
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        self.keys, self.joined, self.ranks = (np.ascontiguousarray(c) for c in table.T)
        self.numbers = np.array([numbers.get(x, -1) for x in symbols], dtype=np.int64)
        self.bytes = np.array(of_bytes, dtype=np.int64)
        self.open = np.array([x.endswith("▁") for x in symbols], dtype=bool)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol and rank of each pair; pairs that don't join have the rank NO_RANK."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        return (np.where(hit, self.joined[at], -1), np.where(hit, self.ranks[at], NO_RANK)) if len(self.keys) else (at - 1, at + NO_RANK)

    def encode(self, runs: Sequence[bytes]) -> tuple[np.ndarray, ...]:
        """Ids, begins and ends of all runs in a row, how many each has, and whether it ends with a blank.

        Runs have SHORT bytes at most, begin with what stands inside a text and hold no U+2581. Characters without a piece
        are negative symbols, which nothing joins, and become byte pieces.
        """
        text = np.frombuffer(b"".join(runs).decode().encode("utf-32-le"), dtype="<u4")
        size = 1 + (text >= 0x80).astype(np.int64) + (text >= 0x800) + (text >= 0x10000)
        ends = np.cumsum([len(r) for r in runs])
        owner = np.searchsorted(ends, np.cumsum(size) - size, side="right")
        code = np.where(text == 0x20, np.uint32(0x2581), text)
        symbol = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        symbol = np.where(self.codes[symbol] == code, symbol, -1 - code.astype(np.int64))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        inner = np.append(owner[1:] == owner[:-1], False)
        joined, rank = np.full(len(owner), -1), np.full(len(owner), NO_RANK)
        at = np.flatnonzero(inner)
        joined[at], rank[at] = self.look_up(symbol[at], symbol[at + 1])
        while len(owner):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(starts, append=len(owner))
            place = np.arange(len(owner)) - np.repeat(starts, lengths)
            best = np.minimum.reduceat(rank * (2 * SHORT) + place, starts)
            ended = best >= NO_RANK * (2 * SHORT)
            if ended.any():
                gone = np.repeat(ended, lengths)
                done.append((symbol[gone], size[gone], owner[gone]))
                symbol, size, owner, joined, rank = (x[~gone] for x in (symbol, size, owner, joined, rank))
                if not len(owner):
                    break
                starts, best = np.cumsum(lengths[~ended]) - lengths[~ended], best[~ended]
            at = starts + best % (2 * SHORT)
            symbol[at] = joined[at]
            size[at] += size[at + 1]
            left = np.ones(len(owner), dtype=bool)
            left[at + 1] = False
            symbol, size, owner, joined, rank = (x[left] for x in (symbol, size, owner, joined, rank))
            at -= np.arange(len(at))  # one symbol less for each run before
            for k in (at[at > 0] - 1, at):
                alive = (k + 1 < len(owner)) & (owner[k] == owner[np.minimum(k + 1, len(owner) - 1)])
                joined[k], rank[k] = -1, NO_RANK
                k = k[alive]
                joined[k], rank[k] = self.look_up(symbol[k], symbol[k + 1])
        symbol, size, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        symbol, size, owner = symbol[order], size[order], owner[order]
        upto = np.cumsum(size)
        last = np.flatnonzero(np.diff(owner, append=-1))
        begin = upto - size - np.repeat(np.append(0, upto[last[:-1]]), np.diff(last, prepend=-1))
        held = np.maximum(symbol, 0)
        is_open = ((symbol >= 0) & self.open[held])[last]
        ids = np.where(symbol >= 0, self.numbers[held], -1)
        code = np.where(symbol >= 0, self.codes[np.minimum(held, len(self.codes) - 1)].astype(np.int64), -1 - symbol)
        n = np.where(ids >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        row = np.repeat(np.arange(len(ids)), n)
        rest = np.repeat(np.cumsum(n), n) - np.arange(len(row)) - 1  # bytes of the character that follow
        head = (rest + 1 == n[row]) & (n[row] > 1)
        part = code[row] >> 6 * rest
        byte = np.where(n[row] == 1, part, np.where(head, part | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n[row]], part & 0x3F | 0x80))
        ids = np.where(ids[row] >= 0, ids[row], self.bytes[np.clip(byte, 0, 255)])
        return ids, begin[row], begin[row] + np.where(rest == 0, size[row], 0), np.bincount(owner[row], minlength=len(runs)), is_open


@dataclass
class PieceModel:
    """A BPE model: pieces with kinds and scores, and how text is normalised."""

    pieces: list[bytes]
    kinds: list[int]
    scores: list[float]
    characters: CharacterMap = field(default_factory=CharacterMap)
    dummy_prefix: bool = True
    squeeze: bool = False
    escape: bool = True
    suffix: bool = False
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    bos: int = -1
    eos: int = -1

    def __post_init__(self) -> None:
        if len(self.pieces) > MAX_PIECES:
            raise ValueError(f"the model has more than {MAX_PIECES} pieces")
        numbered = list(zip(self.pieces, self.kinds, strict=True))
        self.unknown = self.kinds.index(UNKNOWN)
        self.reserved = {p: i for i, (p, k) in enumerate(numbered) if k in (UNKNOWN, CONTROL, BYTE)}
        self.merges = {p: i for i, (p, k) in enumerate(numbered) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.bytes = [self.reserved.get(b"<0x%02X>" % b, self.unknown) for b in range(256)]
        own = sorted((p for p, k in numbered if k == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        # Runs of text part in front of a blank if neither a replacement nor a piece reaches over it.
        reaching = any(BLANK in p.lstrip(BLANK) if not p.startswith(BLANK) else BLANK in _unmarked(p) for p in self.merges)
        self.parts = not (
            reaching or self.suffix or not self.escape or self.characters.has_inner(0x20) or any(b" " in p or BLANK in p for p in own))

        self.plain = (
            self.parts and self.byte_fallback and not self.squeeze and not self.characters.units and self.own is None
            and UNUSED not in self.kinds)
        self.costs = {p.decode(): -self.scores[i] for p, i in self.merges.items()} if self.plain else {}
        self.numbers = {p.decode(): i for p, i in (self.merges | self.reserved).items()} if self.plain else {}
        self.pairs = Pairs(self.costs, self.numbers, self.bytes) if self.plain else None

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Source length and normal form of what stands at ``at``."""
        if self.own is not None and (met := self.own.match(text, at)):
            return met.end() - at, met.group()
        if (met := self.characters.longest(text, at)) is not None:
            return met
        n = character_length(text, at)
        return (n, text[at : at + n]) if n else (1, MALFORMED)

    def normalize(self, text: bytes, first: bool = True, last: bool = True) -> tuple[bytes, list[int]]:
        """The normal form and, for each of its bytes and its end, the place in ``text``.

        ``first`` and ``last`` tell whether ``text`` begins and ends a whole text.
        """
        blank = BLANK if self.escape else b" "
        out, place = bytearray(), []

        def put(part: bytes, at: int) -> None:
            out.extend(part)
            place.extend([at] * len(part))

        at = 0
        if first and self.squeeze:
            while at < len(text) and (step := self._prefix(text, at))[1] == b" ":
                at += step[0]
        if at < len(text) and first and self.dummy_prefix and not self.suffix:
            put(blank, at)
        some = at < len(text)
        after_blank = first and self.squeeze
        while at < len(text):
            length, normal = self._prefix(text, at)
            if after_blank:
                normal = normal.lstrip(b" ")
            if normal:
                put(normal.replace(b" ", blank), at)
                after_blank = self.squeeze and normal.endswith(b" ")
            at += length
        if last and self.squeeze:
            while out.endswith(blank):
                at = place[len(out) - len(blank)]
                del out[-len(blank) :], place[-len(blank) :]
        if some and last and self.dummy_prefix and self.suffix:
            put(blank, at)
        return bytes(out), [*place, at]

    def _symbols(self, normal: bytes) -> tuple[list[bytes], list[bool]]:
        symbols, frozen, at = [], [], 0
        while at < len(normal):
            own = self.own.match(normal, at) if self.own is not None else None
            end = own.end() if own else at + (character_length(normal, at) or 1)
            symbols.append(normal[at:end])
            frozen.append(own is not None)
            at = end
        return symbols, frozen

    def merge(self, normal: bytes) -> list[bytes]:
        """Pieces of normalised text: the best-scored neighbours are joined first, the leftmost of equals."""
        symbols, frozen = self._symbols(normal)
        merges, scores, kinds = self.merges, self.scores, self.kinds
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        parted: dict[bytes, tuple[bytes, bytes]] = {}
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left < 0 or right < 0 or frozen[left] or frozen[right]:
                return
            joined = symbols[left] + symbols[right]
            if (known := merges.get(joined)) is not None:
                heapq.heappush(heap, (-scores[known], left, right, len(joined)))
                if kinds[known] == UNUSED:
                    parted[joined] = symbols[left], symbols[right]

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = b""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])

        def whole(piece: bytes) -> Iterator[bytes]:
            if piece in parted and piece not in self.reserved and kinds[merges[piece]] == UNUSED:
                for part in parted[piece]:
                    yield from whole(part)
            else:
                yield piece

        return [part for symbol in symbols if symbol for part in whole(symbol)]

    def encode(self, text: bytes, first: bool = True, last: bool = True) -> tuple[list[int], list[int], list[int], bool]:
        """Ids, begins and ends in ``text``, and whether the normal form ends with a blank."""
        normal, place = self.normalize(text, first, last)
        ids, begins, ends, at = [], [], [], 0
        for piece in self.merge(normal):
            begin, end = place[at], place[at + len(piece)]
            at += len(piece)
            number = self.reserved.get(piece, self.merges.get(piece, self.unknown))
            if number != self.unknown:
                ids.append(number)
                begins.append(begin)
                ends.append(end)
            elif self.byte_fallback:  # the last byte stands for the whole character
                ids += [self.bytes[b] for b in piece]
                begins += [begin] * len(piece)
                ends += [begin] * (len(piece) - 1) + [end]
            elif ids and ids[-1] == self.unknown:  # unknown neighbours are one
                ends[-1] = end
            else:
                ids.append(number)
                begins.append(begin)
                ends.append(end)
        return ids, begins, ends, not normal or normal.endswith(BLANK)

    def encode_plain(self, run: str, first: bool) -> tuple[list[int], list[int], list[int], bool]:
        """``encode`` of a short run without U+2581 for a ``plain`` model: normalisation only marks blanks."""
        text = run.replace(" ", "▁")
        symbols = list("▁" + text if first and self.dummy_prefix else text)
        cost = self.costs.get
        pairs = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs and (best := min(pairs)) != NEVER:
            k = pairs.index(best)
            symbols[k : k + 2] = [joined := symbols[k] + symbols[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = cost(symbols[k - 1] + joined, NEVER)
            if k < len(pairs):
                pairs[k] = cost(joined + symbols[k + 1], NEVER)
        ids, begins, ends, at = [], [], [], 0
        ascii_only, shift = run.isascii(), first and self.dummy_prefix
        for piece in symbols:
            size = len(piece) if ascii_only else len(piece.encode()) - 2 * piece.count("▁")
            if shift:
                size, shift = size - 1, False
            if (number := self.numbers.get(piece)) is not None:
                ids.append(number)
                begins.append(at)
                ends.append(at + size)
            else:
                data = piece.encode()
                ids += [self.bytes[b] for b in data]
                begins += [at] * len(data)
                ends += [at] * (len(data) - 1) + [at + size]
            at += size
        return ids, begins, ends, not symbols or symbols[-1].endswith("▁")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; a run of byte pieces is read as UTF-8, malformed bytes as U+FFFD."""
        out: list[str] = []
        run = bytearray()
        strips = self.dummy_prefix or self.squeeze
        start = strips
        for number in ids:
            kind = self.kinds[number]
            if kind == BYTE:
                run.append(int(self.pieces[number][3:5], 16))
                continue
            if run:
                out.append(read_bytes(bytes(run)))
                run.clear()
                start = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_surface)
                start = False
                continue
            piece = self.pieces[number].decode()
            if start:
                stripped = piece.removeprefix("▁")
                start = self.squeeze and not stripped if stripped != piece else not piece
                piece = stripped
            out.append(piece.replace("▁", " "))
        out.append(read_bytes(bytes(run)))
        return "".join(out)


def _unmarked(piece: bytes) -> bytes:
    while piece.startswith(BLANK):
        piece = piece[len(BLANK) :]
    return piece


def read_bytes(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            n = character_length(data, at)
            out.append(data[at : at + n].decode() if n else "�")
            at += n or 1
        return "".join(out)


def parse_model(data: bytes) -> PieceModel:
    """A model file's bytes. Only BPE models are known; others are refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    trained, rules = proto.trainer_spec, proto.normalizer_spec
    if trained.model_type != trained.BPE:
        raise ValueError("not a BPE model")
    kinds = [p.type for p in proto.pieces]
    names = [p.piece for p in proto.pieces]

    def control(name: str) -> int:
        return names.index(name) if name in names and kinds[names.index(name)] == CONTROL else -1

    return PieceModel(
        [n.encode() for n in names], kinds, [p.score for p in proto.pieces], CharacterMap(rules.precompiled_charsmap),
        rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces, trained.treat_whitespace_as_suffix,
        trained.byte_fallback, trained.unk_surface, control(trained.bos_piece), control(trained.eos_piece))


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return parse_model(file.read())


class Encoder:
    """Encodes texts run by run: blanks and the word behind them, each different run once."""

    RUNS = re.compile(rb" *[^ ]+| +")

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes | tuple[bytes, bool, bool], int] = {}
        self.open: set[int] = set()
        #: Ids, begins and ends of all runs in a row, and where each run's are.
        self.columns = array("i"), array("i"), array("i")
        self.offsets = array("q", [0])

    def _run(self, run: bytes, first: bool, last: bool) -> int:
        last = last and self.model.squeeze
        key = (run, first, last) if first or last else run
        if (number := self.known.get(key)) is not None:
            return number
        if self.model.plain and len(run) <= SHORT and BLANK not in run:
            *lists, is_open = self.model.encode_plain(run.decode(), first)
        else:
            *lists, is_open = self.model.encode(run, first, last)
        number = self.known[key] = len(self.offsets) - 1
        for column, new in zip(self.columns, lists, strict=True):
            column.extend(new)
        self.offsets.append(len(self.columns[0]))
        if is_open:
            self.open.add(number)
        return number

    def _learn(self, runs: Sequence[bytes]) -> None:
        """Encode short runs that stand inside a text, all at once."""
        ids, begins, ends, counts, is_open = self.model.pairs.encode(runs)
        number = len(self.offsets) - 1
        for column, new in zip(self.columns, (ids, begins, ends), strict=True):
            column.frombytes(new.astype(np.int32).tobytes())
        self.offsets.frombytes((self.offsets[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
        numbers = range(number, number + len(runs))
        self.known.update(zip(runs, numbers, strict=True))
        self.open.update(n for n, o in zip(numbers, is_open.tolist(), strict=True) if o)

    def parted(self, texts: Sequence[bytes]) -> list[list[bytes]]:
        """The runs of each text; what is new among them is learned."""
        parts = [self.RUNS.findall(t) if self.model.parts else [t] if t else [] for t in texts]
        if self.model.pairs is not None:
            new = {r for p in parts for r in p[1:] if r not in self.known and len(r) <= SHORT and BLANK not in r}
            if new:
                self._learn(sorted(new))
        return parts

    def runs(self, parts: list[bytes]) -> tuple[list[int], list[int]]:
        """Numbers of the runs of a text and their lengths."""
        if not parts:
            return [], []
        final = len(parts) - 1
        numbers = [self._run(parts[0], True, not final)]
        if final:
            numbers += map(self.known.get, parts[1:final])
            numbers.append(self._run(parts[final], False, True))
        if None in numbers:
            numbers = [self._run(p, False, False) if n is None else n for p, n in zip(parts, numbers, strict=True)]
        if self.open.isdisjoint(numbers[:-1]):
            return numbers, list(map(len, parts))
        joined: list[bytes] = []
        numbers, held = [], b""
        for k, part in enumerate(parts):
            held += part
            number = self._run(held, not joined, k == final)
            if number not in self.open or k == final:  # the blank at its end may join the next one
                joined.append(held)
                numbers.append(number)
                held = b""
        return numbers, list(map(len, joined))

    def texts(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of all texts one after the other, with begin and end ids, and how many each text has."""
        if len(self.offsets) > REMEMBERED:
            self._forget()
        numbers, lengths, sizes = [], [], []
        for parts in self.parted(texts):
            run, length = self.runs(parts)
            numbers += run
            lengths += length
            sizes.append(len(run))
        run, sizes = np.array(numbers, dtype=np.int64), np.array(sizes, dtype=np.int64)
        length = np.array(lengths, dtype=np.int64)
        whole = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(length) - length - np.repeat(np.cumsum(whole) - whole, sizes)
        offsets = np.array(self.offsets, dtype=np.int64)
        n = offsets[run + 1] - offsets[run]
        take = np.arange(n.sum()) + np.repeat(offsets[run] - (np.cumsum(n) - n), n)
        ids, begins, ends = (np.array(c, dtype=np.int64)[take] for c in self.columns)
        base = np.repeat(base, n)
        return self._framed(ids, begins + base, ends + base, n, sizes, texts)

    def _framed(self, ids, begins, ends, n, sizes, texts):
        """Begin and end ids around each text, with empty spans."""
        owner = np.repeat(np.arange(len(texts)), sizes)
        count = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
        edge = np.cumsum(count)
        length = np.array([len(t) for t in texts], dtype=np.int64)
        # numpy inserts in the order given where places are equal: an end id comes before the next text's begin id.
        places, extra, spans = [], [], []
        for mark, place, span in ((self.model.bos, edge - count, length * 0), (self.model.eos, edge, length)):
            if mark >= 0:
                places.append(place)
                extra.append(np.full(len(texts), mark, dtype=np.int64))
                spans.append(span)
        if places:
            order = np.argsort(np.concatenate([np.arange(len(texts)) for _ in places]), kind="stable")
            where, what, span = (np.concatenate(x)[order] for x in (places, extra, spans))
            ids, begins, ends = np.insert(ids, where, what), np.insert(begins, where, span), np.insert(ends, where, span)
        return ids, begins, ends, count + len(places)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Little-endian 32-bit numbers, ``counts`` of them in each row."""
    offsets = np.zeros(len(counts) + 1, dtype="<i4")
    np.cumsum(counts * 4, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``(doc_id, ids, begins, ends)`` for each row of ``docs (doc_id, text)``: three rows of little-endian 32-bit numbers.

    Every id has the byte span of the text it stands for; the spans of a text's pieces follow each other without gap but
    where normalisation drops blanks. Of a character in byte pieces the last has the span, the others are empty before it;
    begin and end ids have empty spans at the ends of the text.

    NULL and empty texts have begin and end ids alone; a NULL doc_id stays; repeated rows are encoded alike; other columns
    are ignored; an empty table gives no rows. The model is broadcast, its size bounded by MAX_PIECES.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, begins, ends, counts = encoder.texts([t.as_py() or b"" for t in part.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(_binary(x, counts) for x in (ids, begins, ends))],
                    names=["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids in column ``ids``; NULL ids give an empty text.

    A column of that name is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        plain = np.array([k in (NORMAL, USER_DEFINED, UNUSED) for k in m.kinds])
        surface = [p.decode("utf-8", "replace").replace("▁", " ") for p in m.pieces]
        strips = m.dummy_prefix and not m.squeeze
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = []
                for value in part.column(at):
                    ids = np.frombuffer(value.as_py() or b"", dtype="<u4")
                    inner = ids[int(len(ids) > 0 and ids[0] == m.bos) : len(ids) - int(len(ids) > 0 and ids[-1] == m.eos)]
                    if strips and len(inner) and plain[inner].all():
                        text = "".join(map(surface.__getitem__, inner.tolist()))
                        texts.append(text[1:] if m.pieces[inner[0]].startswith(BLANK) else text)
                    else:
                        texts.append(m.decode(ids.tolist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, decoded string")


def spans(encoded: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, position, id, begin, end, surface)``: a row for each id of ``encoded``, with the text of its span.

    Texts meet their ids by doc_id, which must be unique and not NULL.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, text, *packed = (column[row].as_py() for column in batch.columns)
                ids, begins, ends = (np.frombuffer(p, dtype="<u4") for p in packed)
                whole = text or b""
                for start in range(0, len(ids), 65536):
                    cut = slice(start, start + 65536)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(ids[cut]), pa.int64()), pa.array(np.arange(len(ids))[cut], pa.int64()),
                         pa.array(ids[cut], pa.int64()), pa.array(begins[cut], pa.int64()), pa.array(ends[cut], pa.int64()),
                         pa.array([whole[b:e] for b, e in zip(begins[cut], ends[cut], strict=True)], pa.binary())],
                        names=["doc_id", "position", "id", "begin", "end", "surface"])

    joined = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).join(encoded, "doc_id")
    return joined.select("doc_id", "text", "ids", "begins", "ends").mapInArrow(
        run, "doc_id bigint, position bigint, id bigint, begin bigint, end bigint, surface binary")
