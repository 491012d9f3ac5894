"""Sentencepiece encoding that keeps the source bytes of every piece, and decoding.

The model file is read as it is: its pieces, and its normaliser with the compiled character map, a
double array of rules followed by their replacements. At each place of a text the longest rule that
matches is applied, else one character is copied; white space is escaped as the model says. The
normaliser returns, for every byte of the normalised text, where it comes from. The normalised text
is cut where no piece of the vocabulary goes on, so equal cuts are merged once: pairs of symbols by
score, the leftmost first. The boundaries of the surviving pieces, projected through the alignment,
are byte spans of the original text. Unknown characters become byte pieces (the last one carries the
span) or the unknown piece. Decoding joins pieces and bytes and takes the mark of the first word away.

Defined cases: a null or empty text has no pieces and decodes to an empty text. Repeated rows are
encoded each. An empty table gives an empty result. Other columns are ignored. The length of a text
has no limit: batches are cut by bytes, a cut word merges with a heap. Models other than merge models
(BPE), and pieces that users defined, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nitrogrid.llm.common import id_and_text, pieces_of, texts

MARK = "▁"
BATCH_BYTES = 1 << 17
POOLED = 4_000_000  # pieces that a worker keeps for words met before
SHORT = 64  # characters of words that are merged many at once
NO_PAIR = 1 << 60
UNIT_OFFSET_BITS = 10

_loaded: dict[str, Codec] = {}


def fields(message: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, message[at:at + size]
        at += size


def compiled_rules(blob: bytes) -> dict[bytes, bytes]:
    """All rules (source to replacement) of a compiled character map."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    replacements = blob[4 + size:]
    rules = {}

    def base(node: int) -> int:
        unit = units[node]
        return node ^ ((unit >> UNIT_OFFSET_BITS) << ((unit & (1 << 9)) >> 6))

    open_nodes = [(0, b"")]
    while open_nodes:
        node, prefix = open_nodes.pop()
        below = base(node)
        if prefix and units[node] >> 8 & 1:
            start = units[below] & 0x7FFFFFFF
            rules[prefix] = replacements[start:replacements.index(b"\0", start)]
        for byte in range(1, 256):
            child = below ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                open_nodes.append((child, prefix + bytes([byte])))
    return rules


@dataclass
class Normaliser:
    """Rules and white space handling of a model. The rules are kept by their longest source per first character."""
    rules: dict[str, str] = field(default_factory=dict)
    prefix: bool = True
    shorten: bool = True
    escape: bool = True

    def __post_init__(self):
        self.longest: dict[str, int] = {}
        for source in self.rules:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))
        self.space = MARK if self.escape else " "

    def replaced(self, text: str) -> tuple[str, np.ndarray]:
        """The text after the longest rules, and for each of its characters the source byte its chunk begins at, and the end."""
        sizes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (sizes > 0x7F) + (sizes > 0x7FF) + (sizes > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
        if not self.longest or not self.longest.keys() & set(text):
            return text, offset
        out, origin, at = [], [], 0
        while at < len(text):
            most = self.longest.get(text[at], 0)
            for n in range(min(most, len(text) - at), 0, -1):
                found = self.rules.get(text[at:at + n])
                if found is not None:
                    break
            else:
                n, found = 1, text[at]
            out.append(found)
            origin.extend([offset[at]] * len(found))
            at += n
        return "".join(out), np.array([*origin, offset[-1]], np.int64)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and the end) the source byte."""
        body, origin = self.replaced(text)
        if self.shorten:
            spaces = np.frombuffer(body.encode("utf-32-le"), np.uint32) == 0x20
            keep = ~spaces
            keep[1:] |= ~spaces[:-1]
            if len(keep):
                keep[0] = not spaces[0]
                last = np.flatnonzero(~spaces)
                keep[last[-1] + 1 if len(last) else 0:] = False
            body = "".join(np.array(list(body), object)[keep].tolist()) if not keep.all() else body
            end = origin[-1] if keep.all() or not keep.any() else origin[np.flatnonzero(keep)[-1] + 1]
            origin = np.append(origin[:-1][keep], end)
        if not body:
            return "", np.zeros(1, np.int64)
        body = body.replace(" ", self.space)
        if self.prefix:
            body, origin = self.space + body, np.insert(origin, 0, origin[0])
        if self.shorten:  # marks that the text itself ends with go as well
            body = body.rstrip(self.space)
            origin = origin[:len(body) + 1]
        return body, origin


class Codec:
    """A model's pieces, and the pieces of the words met so far in flat arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        spec, kind = {}, 1
        for number, value in fields(model.serialized_model_proto()):
            if number == 3:
                spec = dict(fields(value))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
        rules = {a.decode(): b.decode() for a, b in compiled_rules(spec.get(2, b"")).items()}
        self.normaliser = Normaliser(rules, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        types = [dict(fields(value)).get(3, 1) for number, value in fields(model.serialized_model_proto()) if number == 1]
        if kind != 2 or 4 in types or 5 in types:
            raise ValueError("only merge models without user-defined or unused pieces")
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.unknown = model.unk_id()
        byte = [i for i in range(size) if model.is_byte(i)]
        self.byte_id = {int(names[i][3:5], 16): i for i in byte}
        self.written = [b""] * size  # what each piece writes when it is decoded
        for i in plain:
            self.written[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.written[i] = bytes([b])
        self.written[self.unknown] = self.surface().encode()
        self.named = [str(i) for i in range(size)]
        self.marked = {i for i in plain if names[i].startswith(MARK)}
        # words begin with their marks; no piece may hold a mark behind another character
        assert not any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in plain)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
        # symbols and pairs by number, for merging many words at once
        self.symbols = sorted({*self.ids, *(c for name in self.ids for c in name)})
        self.symbol_number = {symbol: k for k, symbol in enumerate(self.symbols)}
        rank = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = {}
        for name, score in self.score.items():
            for i in range(1, len(name)):
                left, right = self.symbol_number.get(name[:i]), self.symbol_number.get(name[i:])
                if left is not None and right is not None:
                    pairs[left * len(self.symbols) + right] = rank[score], self.symbol_number[name]
        self.piece_of_symbol = np.array([self.ids.get(x, -1) for x in self.symbols], np.int64)
        self.pair_key = np.array([*sorted(pairs), NO_PAIR], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in sorted(pairs)), NO_PAIR], np.int64)
        self.pair_made = np.array([*(pairs[k][1] for k in sorted(pairs)), 0], np.int64)
        self.emptied()

    def surface(self) -> str:
        """What stands for the unknown piece in a decoded text."""
        return self.model.decode([self.unknown])

    def emptied(self):
        """Forgets all words."""
        self.number: dict[str, int] = {}
        self.first = array("q", [0])   # of each word its first place in the two arrays below
        self.piece = array("i")
        self.chars = array("i")        # characters of the normalised text that the piece covers

    def merged(self, word: str) -> list[str]:
        """The symbols of one word once no pair of neighbours is a piece."""
        if word in self.score and len(word) == 1:
            return [word]
        score = self.score
        symbols: list[str] = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = score.get(symbols[i] + symbols[k])
                if s is not None:
                    heapq.heappush(heap, (-s, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                s = score.get(symbols[h] + symbols[i])
                if s is not None:
                    heapq.heappush(heap, (-s, h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def merged_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merged(word) of many short words at once: in each round every word joins its best pair.

        Gives the numbers of the symbols (-1: not in any piece), in order, the first character of
        each in all words joined, and how many symbols each word has.
        """
        joined = "".join(words)
        symbol = np.fromiter(map(self.symbol_number.get, joined, repeat(-1)), np.int64, len(joined))
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        start, done = np.arange(len(joined)), []
        rank, made = self.pairs(symbol, np.append(symbol[1:], -1))
        rank[np.append(owner[1:] != owner[:-1], True)] = NO_PAIR
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            n = np.diff(np.append(first, len(owner)))
            alive = np.repeat(least < NO_PAIR, n)
            done.append((owner[~alive], start[~alive], symbol[~alive]))
            best = np.flatnonzero(alive & (rank == np.repeat(least, n)))
            if not len(best):
                break
            best = best[np.append(True, owner[best[1:]] != owner[best[:-1]])]
            symbol[best] = made[best]
            alive[best + 1] = False
            place = (np.cumsum(alive) - 1)[best]
            symbol, start, owner, rank, made = symbol[alive], start[alive], owner[alive], rank[alive], made[alive]
            # only the pairs on both sides of what was joined are new
            new = np.concatenate([place, place[place > 0] - 1])
            after = np.minimum(new + 1, len(symbol) - 1)
            rank[new], made[new] = self.pairs(symbol[new], np.where((after > new) & (owner[after] == owner[new]), symbol[after], -1))
        owner, start, symbol = (np.concatenate(column) for column in zip(*done, strict=True))
        order = np.argsort(start)
        return symbol[order], start[order], np.bincount(owner, minlength=len(words))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols (NO_PAIR: no piece), and what it becomes."""
        key = left * len(self.symbols) + right
        at = np.searchsorted(self.pair_key, key)
        good = (self.pair_key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.pair_rank[at], NO_PAIR), self.pair_made[at]

    def learn(self, words: list[str]):
        """Encodes new words and numbers them."""
        short = [w for w in words if len(w) <= SHORT]
        if short:
            joined = "".join(short)
            symbol, start, n = self.merged_together(short)
            piece = np.where(symbol >= 0, self.piece_of_symbol[symbol], -1)
            size = np.diff(np.append(start, len(joined)))
            odd = np.flatnonzero(piece < 0)
            if len(odd):
                piece, size, n = self.expanded(piece, size, n, odd, [joined[i] for i in start[odd].tolist()])
            self.add(short, piece, size, n)
        for word in words:
            if len(word) > SHORT:
                symbols = self.merged(word)
                piece = np.array([self.ids.get(x, -1) for x in symbols], np.int64)
                size, n = np.fromiter(map(len, symbols), np.int64, len(symbols)), np.array([len(symbols)])
                odd = np.flatnonzero(piece < 0)
                if len(odd):
                    piece, size, n = self.expanded(piece, size, n, odd, [symbols[i] for i in odd.tolist()])
                self.add([word], piece, size, n)

    def add(self, words: list[str], piece: np.ndarray, size: np.ndarray, n: np.ndarray):
        begin = len(self.piece)
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        self.chars.frombytes(size.astype(np.int32).tobytes())
        self.first.frombytes((begin + np.cumsum(n)).astype(np.int64).tobytes())
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))

    def expanded(self, piece: np.ndarray, size: np.ndarray, n: np.ndarray, odd: np.ndarray, unknown: list[str]):
        """Pieces, sizes and counts per word with byte pieces, or the unknown piece, in place of unknown symbols."""
        owner = np.repeat(np.arange(len(n)), n)
        times = np.ones(len(piece), np.int64)
        if self.byte_id:
            fill = [self.byte_id[b] for u in unknown for b in u.encode()]
            times[odd] = [len(u.encode()) for u in unknown]
        else:
            fill = [self.unknown] * len(odd)
        wide = np.repeat(piece, times)
        wide[wide < 0] = fill
        last = np.cumsum(times) - 1
        sizes = np.zeros(len(wide), np.int64)
        sizes[last] = size
        owner = np.repeat(owner, times)
        if not self.byte_id:  # unknown neighbours are one piece
            follows = np.append(False, (wide[1:] == self.unknown) & (wide[:-1] == self.unknown) & (owner[1:] == owner[:-1]))
            sizes = np.add.reduceat(sizes, np.flatnonzero(~follows))
            wide, owner = wide[~follows], owner[~follows]
        return wide, sizes, np.bincount(owner, minlength=len(n))

    def words(self, normalised: str) -> list[str]:
        if self.byte_id:
            return self.cut.findall(normalised)
        # unknown characters on both sides of a cut would be one piece, so the text stays whole
        return [normalised] if normalised else []

    def encode_all(self, some: list[str]) -> list[Encoded]:
        """The texts encoded; to be read before the next call, which may forget words."""
        if len(self.piece) > POOLED:
            self.emptied()
        found, new = [], set()
        for text in some:
            normalised, origin = self.normaliser.normalised(text)
            words = self.words(normalised)
            numbers = list(map(self.number.get, words))
            if None in numbers:
                new.update(w for w, n in zip(words, numbers, strict=True) if n is None)
                numbers = words  # looked up again once they are learnt
            found.append((numbers, origin))
        self.learn(sorted(new))
        get = self.number.__getitem__
        return [Encoded(self, list(map(get, n)) if n and isinstance(n[0], str) else n, origin) for n, origin in found]

    def encode(self, text: str) -> Encoded:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8; bytes that are no characters become the replacement character each."""
        found = b"".join(map(self.written.__getitem__, ids))
        spaced = self.normaliser.prefix or self.normaliser.shorten
        head = next((i for i in ids if self.written[i]), None)
        found = found[1:] if spaced and head in self.marked else found
        try:
            found.decode()
        except UnicodeDecodeError:
            return singly_replaced(found)
        return found


def singly_replaced(raw: bytes) -> bytes:
    """UTF-8 in which each byte that belongs to no character is a replacement character."""
    text = raw.decode(errors="surrogateescape")
    return re.sub("[\ud800-\udfff]", "�", text).encode()


@dataclass
class Encoded:
    """One text: the numbers of its words, and the source bytes of its normalised characters."""
    codec: Codec
    words: list[int]
    origin: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        """Where the pieces of all words stand in the codec's arrays."""
        words = np.array(self.words, np.int64)
        first = np.frombuffer(self.codec.first, np.int64)
        start, n = first[words], first[words + 1] - first[words]
        return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(words) else words

    def ids(self) -> np.ndarray:
        return np.frombuffer(self.codec.piece, np.int32)[self.places] if self.words else np.zeros(0, np.int32)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First source byte of each piece and the byte after its last."""
        if not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.cumsum(np.frombuffer(self.codec.chars, np.int32)[self.places], dtype=np.int64)
        begin = np.concatenate([[0], end[:-1]])
        return self.origin[begin], self.origin[end]

    def decoded(self) -> bytes:
        return self.codec.decode(self.ids().tolist())


def codec(path: str | None) -> Codec:
    import public_tokenizers

    where = path or public_tokenizers.path("piece_bpe_32k.model")
    if where not in _loaded:
        _loaded[where] = Codec(where)
    return _loaded[where]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids, begins, ends (source bytes of each piece), decoded."""

    def encode(batches):
        model = codec(path)
        for batch in batches:
            for part in pieces_of(batch, BATCH_BYTES):
                found = []
                for e in model.encode_all(texts(part)):
                    found.append((e.ids(), *e.spans(), e.decoded().decode()))
                ids, begins, ends, decoded = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int64())),
                     pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "begins", "ends", "decoded"])

    return id_and_text(docs).mapInArrow(encode, "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, and spans_sha256: the pairs of source
    offsets of all pieces (first byte, byte after the last) as little-endian 64-bit integers."""

    def encode(batches):
        model = codec(path)
        for batch in batches:
            for part in pieces_of(batch, BATCH_BYTES):
                rows = []
                for e in model.encode_all(texts(part)):
                    ids = e.ids().tolist()
                    spans = np.stack(e.spans(), axis=1).astype("<i8").tobytes()
                    rows.append((len(ids), sha(",".join(map(model.named.__getitem__, ids)).encode()), sha(model.decode(ids)),
                                 int(e.origin[-1]), sha(spans)))
                n, ids, decoded, size, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(size, pa.int64()),
                     pa.array(spans)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"])

    return id_and_text(docs).mapInArrow(
        encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
