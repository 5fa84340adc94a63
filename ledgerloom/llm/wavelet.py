"""Token ids in wavelet-matrix shards.

A shard's tokens are kept as bit-planes from the highest bit down; at each level the zeros of the level
above come first, then its ones, both in order. With the number of ones before each block of 512 bits a
plane answers rank and select, and the planes together answer token access, counting and the place of
the k-th occurrence, all from the one compressed payload. A payload also has the documents' ids and
where each begins.

Shards are ranges of doc_id whose bounds are quantiles of the ids (by regions where there are many), so that
text is encoded once, only token ids are shuffled, and a shard is written by one task from a sorted stream,
in payloads of about `payload_tokens` tokens. A payload is a row of a Parquet file: Spark commits the files, any executor can
read them, and a rerun writes to another folder. A document is never split, so a payload is as large as
one document at least.

Defined results: null text counts as empty and has the end token alone; null ids come first; repeated
ids are ordered by their tokens; an empty table writes no payload; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import operator
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, arrow_batches, scratch

END_TOKEN = 1
SHARD_CHARS = 32 << 20
PAYLOAD_TOKENS = 2 << 20
#: Ranges of doc_id that one sketch cuts the table into at most.
REGIONS = 512
#: Words whose tokens a worker remembers at most.
CACHED_WORDS = 1_000_000

_MAGIC, _BLOCK = b"WVM1", 512
_HEAD = struct.Struct("<4sIIQ")
_NULL_ID = -(1 << 63)


def _pack(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-max(len(bits), 1) // _BLOCK) * _BLOCK, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little")


class WaveletMatrix:
    """Planes of packed bits, highest first, with the zeros of each and the ones before each block."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: np.ndarray, ones: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @classmethod
    def build(cls, tokens: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros, ones, at = [], [], [], tokens
        for level in range(levels):
            bits = ((at >> (levels - 1 - level)) & 1).astype(bool)
            packed = _pack(bits)
            counts = np.bitwise_count(packed.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1)
            planes.append(packed)
            ones.append(np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.uint32))
            zeros.append(len(at) - int(counts.sum()))
            at = np.concatenate((at[~bits], at[bits]))
        return cls(len(tokens), planes, np.array(zeros, dtype=np.uint64), ones)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def rank(self, level: int, i: int) -> int:
        """Ones before position i of a level."""
        block = min(i // _BLOCK, len(self.ones[level]) - 1)
        bits = np.unpackbits(self.planes[level][block * 64 : -(-i // 8)], bitorder="little")
        return int(self.ones[level][block]) + int(bits[: i - block * _BLOCK].sum())

    def select(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit that equals `one`."""
        ones = self.ones[level].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * _BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * 64 : block * 64 + 64], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def access(self, i: int) -> int:
        token = 0
        for level in range(len(self.planes)):
            one, before = self.bit(level, i), self.rank(level, i)
            token = token << 1 | one
            i = int(self.zeros[level]) + before if one else i - before
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self.rank(level, start), self.rank(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs from position start to end."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        start, end = (0, 0) if token >> len(self.planes) else self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: each level's order is undone from the lowest up."""
        out = np.zeros(self.n, dtype=np.uint32)
        for level in reversed(range(len(self.planes))):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty_like(out), int(self.zeros[level])
            above[~bits] = out[:zeros]
            above[bits] = out[zeros:] | np.uint32(1 << (len(self.planes) - 1 - level))
            out = above
        return out

    def to_bytes(self) -> bytes:
        parts = [_HEAD.pack(_MAGIC, len(self.planes), len(self.ones[0]) if self.ones else 0, self.n), self.zeros.tobytes()]
        parts += [x.tobytes() for level in zip(self.planes, self.ones, strict=True) for x in level]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, levels, blocks, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at = _HEAD.size
        zeros = np.frombuffer(data, np.uint64, levels, at)
        at += 8 * levels
        planes, ones = [], []
        for _ in range(levels):
            planes.append(np.frombuffer(data, np.uint8, blocks * 64, at))
            ones.append(np.frombuffer(data, np.uint32, blocks, at + blocks * 64))
            at += blocks * 68
        return cls(n, planes, zeros, ones)


def pack_payload(ids: list[int], lengths: list[int], tokens: np.ndarray) -> bytes:
    """One compressed payload: documents' ids and token counts, then the wavelet matrix."""
    levels = max(1, int(tokens.max(initial=0)).bit_length())
    body = WaveletMatrix.build(tokens, levels).to_bytes()
    head = struct.pack("<Q", len(ids)) + np.array(ids, dtype=np.int64).tobytes() + np.array(lengths, dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack_payload(payload: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<Q", data)
    ids, lengths = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    return ids, lengths, WaveletMatrix.from_bytes(data[8 + 16 * n :])


#: The encoder of this worker, by path: loading a vocabulary takes longer than many a task.
_encoders: dict[str, _Encoder] = {}

#: Signs that often close a word, and a control character to put between words.
_CLOSING, _MARK = ".,;:!?#$%&*", "\x01"


def _bytes(column: pa.Array) -> list[bytes]:
    """The strings or bytes of an Arrow column without nulls (faster than to_pylist where there are many)."""
    return column.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class _Encoder:
    """Texts -> token ids as little-endian numbers, the ids that the library gives for the whole text.

    Where the vocabulary's own normaliser and pre-tokeniser keep words apart at ASCII white space, each distinct word of a batch is
    encoded by itself and remembered. Case goes first where the normaliser drops it. A word of letters that the normaliser leaves
    alone and the pre-tokeniser keeps together is a piece for the library's model, with closing signs cut off behind it. Of other
    words many new ones go to a call: those of ASCII apart by a space and told by their lengths where the vocabulary's tokens have
    lengths, others with a mark between them. Each of these is tried on the vocabulary; what it doesn't allow is left to the library, as is
    each text with a special token in it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        ids = self.tokenizer.get_vocab(with_added_tokens=True).values()
        self.width = "<u2" if max(ids, default=0) < 1 << 16 else "<u4"
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        pieces = self._pieces
        spaces = [*WHITESPACE, "  ", "\r\n"]
        self.apart = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) and all(
            pieces(f"{w}{a}{w}{b}{w}") == pieces(a) + pieces(b) for w in spaces for a in ("a", "!", "7", "\u00e9") for b in ("b", "'s", "\u0301", "\u00df")
        )
        plain = "".join(map(chr, range(33, 127)))
        self.folds = self.apart and pieces(plain) == pieces(plain.lower()) and all(pieces(c) == pieces(c.lower()) for c in plain)
        letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x180)) if chr(c).isalpha()] if self.apart else []
        tails = [*_CLOSING, *(x + y for x in _CLOSING for y in _CLOSING)]
        self.closing = _CLOSING.encode() if self.apart else b""
        #: Letters, by their last byte or two, behind which closing signs are tokens of their own.
        cut = [c for c in letters if pieces(" ".join(f"a{c}{t}" for t in tails)) == [p for t in tails for p in (*pieces(f"a{c}"), *pieces(t))]]
        self.letters = {c.encode()[-2:] for c in cut}
        self.alphabet = self._alphabet(cut)
        mark = self._ids(_MARK)
        self.mark = int(mark[0]) if self.apart and len(mark) == 1 and pieces(f"a {_MARK} b") == [*pieces("a"), *pieces(_MARK), *pieces("b")] else None

        self.lengths = self._lengths() if self.apart else None
        self.plain = f"^[{''.join(map(chr, self.alphabet))}]+[{_CLOSING}]*$" if self.alphabet else None

    def _alphabet(self, letters: list[str]) -> dict[int, str]:
        """Those of some letters that the normaliser leaves alone and that are one piece with others, each with what the model knows it as."""
        normaliser, pieces = self.tokenizer.normalizer, self._pieces
        found = {c: pieces(c) for c in letters if normaliser is None or normaliser.normalize_str(c) == c}
        found = {c: p[0] for c, p in found.items() if len(p) == 1 and pieces(f"a{c}a") == [pieces("a")[0] + p[0] + pieces("a")[0]]}
        order = list(found)
        together = all(pieces("".join(o)) == ["".join(found[c] for c in o)] for o in (order, order[::-1], order[::2] + order[1::2]))
        return {ord(c): p for c, p in found.items()} if together else {}

    def _lengths(self) -> np.ndarray | None:
        """Bytes of text that each token stands for, where a vocabulary of byte pairs has neither unknown tokens nor prefixes: the
        tokens of a word of ASCII letters and signs then have its length in all."""
        model = json.loads(self.tokenizer.to_str())["model"]
        if model.get("type", "BPE") != "BPE" or "merges" not in model or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout"):
            return None
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        lengths = np.zeros(max((*vocab.values(), *self.tokenizer.get_added_tokens_decoder()), default=0) + 1, dtype=np.int64)
        for token, at in vocab.items():
            lengths[at] = len(token.removesuffix(suffix))
        return lengths

    def _pieces(self, text: str) -> list[str]:
        """What the vocabulary's merges work on."""
        normaliser, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normaliser.normalize_str(text) if normaliser else text
        return [p for p, _ in cutter.pre_tokenize_str(text)] if cutter else [text]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width)

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """A word as what its tokens depend on: without case, and closing signs apart from the letter before them."""
        stem = word.rstrip(self.closing)
        if stem != word and not (stem[-1:] in self.letters or stem[-2:] in self.letters):
            stem = word
        return (stem.lower() if self.folds and stem.isascii() else stem), word[len(stem) :]

    def _learn(self, words: pa.Array) -> None:
        """Learn new words: those of plain letters here, others by _learn_others."""
        known, model = self.known, self.tokenizer.model
        if self.plain is None:
            self._learn_others(_bytes(words))
            return
        folded = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words) if self.folds else words
        plain = pc.match_substring_regex(folded, self.plain)
        self._learn_others(_bytes(words.filter(pc.invert(plain))))
        words, folded = words.filter(plain), folded.filter(plain)
        stems = pc.utf8_rtrim(folded, characters=_CLOSING)
        tails = pc.utf8_ltrim(folded, characters="".join(map(chr, self.alphabet)))
        self._learn_others([t for t in _bytes(tails.unique()) if t not in known])
        new = [s for s in _bytes(stems.unique()) if s not in known]
        pieces = b" ".join(new).decode().translate(self.alphabet).split(" ") if new else []
        ids = [[t.id for t in model.tokenize(piece)] for piece in pieces]
        ends = np.dtype(self.width).itemsize * np.cumsum([0, *map(len, ids)])
        data = np.fromiter(itertools.chain.from_iterable(ids), self.width).tobytes()
        known.update(zip(new, (data[a:b] for a, b in itertools.pairwise(ends.tolist())), strict=True))
        tokens = map(operator.add, map(known.__getitem__, _bytes(stems)), map(known.__getitem__, _bytes(tails)))
        known.update(zip(_bytes(words), tokens, strict=True))

    def _learn_others(self, words: list[bytes]) -> None:
        known, size, folds, closing = self.known, np.dtype(self.width).itemsize, self.folds, set(self.closing)
        new, parts = set(), []
        for word in words:
            stem, tail = self._parts(word) if word[-1] in closing else (word.lower() if folds and word.isascii() else word, b"")
            if stem == word:
                new.add(word)
            else:
                parts.append((word, stem, tail))
        new.update(p for _, *both in parts for p in both if p and p not in known)
        if self.lengths is not None:
            new = self._learn_plain([w for w in new if w.isascii()]) + [w for w in new if not w.isascii()]
        together = [w for w in new if _MARK.encode() not in w] if self.mark is not None else []
        for at in range(0, len(together), 500):
            part = together[at : at + 500]
            between = f" {_MARK} "
            ids = self._ids(between + between.join([w.decode() for w in part]))
            cuts = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            data = ids.tobytes()
            for word, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                known[word] = data[size * (a + 1) : size * b]
        for word in new:
            if word not in known:
                known[word] = self._ids(word.decode()).tobytes()
        for word, stem, tail in parts:
            known[word] = known[stem] + known[tail] if tail else known[stem]

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Learn words of ASCII with nothing but a space between them: cut where the lengths of tokens add up to those of words.
        Those of calls whose lengths don't add up come back."""
        known, size, left = self.known, np.dtype(self.width).itemsize, []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = self._ids(b" ".join(part).decode())
            lengths, ends = self.lengths[ids], np.cumsum([len(w) for w in part])
            sums = np.cumsum(lengths)
            # No token stands for more than its bytes, so equal sums in all mean equal sums of each word.
            if not len(ids) or sums[-1] != ends[-1] or not lengths.all():
                left += part
                continue
            cuts = np.searchsorted(sums, ends) + 1
            if (sums[cuts - 1] != ends).any():
                left += part
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(part, (size * cuts).tolist(), strict=True):
                known[word] = data[begin:end]
                begin = end
        return left

    def encode_column(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text of a string column, null counting as empty, and the number `end` after each."""
        size, last = np.dtype(self.width).itemsize, np.array([] if end is None else [end], dtype=self.width)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pa.array([not self.apart] * len(texts), pa.bool_())
        for token in self.added:
            special = pc.or_(special, pc.match_substring(texts, token, ignore_case=True))
        whole = [np.concatenate((self._ids(t), last)).tobytes() for t in texts.filter(special).to_pylist()]
        if len(whole) == len(texts):
            return pa.array(whole, pa.binary())
        shown = pc.if_else(special, "", texts)
        words = pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(shown), pc.ascii_lower(shown), shown) if self.folds else shown)
        coded = words.flatten().dictionary_encode()
        tokens = pa.array(self._tokens(coded.dictionary), pa.binary()).take(coded.indices)
        # The tokens of all words lie in one buffer, in order: what is left is to add the ends and to cut at them.
        offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, 4 * tokens.offset)
        ends = offsets[words.offsets.to_numpy() - words.offsets[0].as_py()] // size
        ids = np.frombuffer(tokens.buffers()[2], self.width, ends[-1]) if ends[-1] else np.zeros(0, self.width)
        if len(last):
            ids, ends = np.insert(ids, ends[1:], end), ends + np.arange(len(ends))
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((size * ends).astype(np.int32)), pa.py_buffer(ids)])
        return pc.replace_with_mask(out, special, pa.array(whole, pa.binary())) if whole else out

    def _tokens(self, words: pa.Array) -> list[bytes]:
        """The tokens of distinct words."""
        keys = _bytes(words)
        if len(self.known) > CACHED_WORDS:
            self.known = {w: self.known[w] for w in keys if w in self.known}
        self.known[b""] = b""
        found = list(map(self.known.get, keys))
        new = [i for i, t in enumerate(found) if t is None]
        if new:
            self._learn(words.take(pa.array(new, pa.int64())))
            found = list(map(self.known.__getitem__, keys))
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _bounds(ids: DataFrame, n_shards: int, regions: int = REGIONS) -> np.ndarray:
    """The least doc_id of each shard but the first, shards having like numbers of rows.

    Sketches stay small at any number of shards: one of the whole cuts it into regions, and each region is cut
    by a sketch of its own. What comes to the driver is a number per shard."""
    def quantiles(n: int) -> list[float]:
        return [i / n for i in range(1, n)]

    ids = ids.where("doc_id is not null")
    n_regions = min(n_shards, regions)
    coarse = np.array(sorted({int(b) for b in ids.approxQuantile("doc_id", quantiles(n_regions), 0.01 / n_regions)} if n_regions > 1 else ()), dtype=np.int64)
    per_region = -(-n_shards // n_regions)
    if per_region == 1:
        return coarse

    def deal(batches):
        for batch in arrow_batches(batches):
            region = np.searchsorted(coarse, batch.column(0).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(region)], ["doc_id", "region"])

    dealt = ids.mapInArrow(deal, "doc_id long, region int")
    fine = dealt.groupBy("region").agg(F.percentile_approx("doc_id", quantiles(per_region), 100 * per_region).alias("bounds")).collect()
    return np.unique(np.concatenate([coarse, *(np.array(r["bounds"], dtype=np.int64) for r in fine)]))


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, shard_chars: int = SHARD_CHARS, payload_tokens: int = PAYLOAD_TOKENS) -> None:
    """Encode docs and write their shards under path, in ascending order of doc_id."""
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = frame.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bounds = _bounds(frame.select("doc_id"), max(1, -(-chars // shard_chars)))
    width = _encoder(tokenizer_path).width
    token_bytes = np.dtype(width).itemsize

    def encode(batches):
        encoder = _encoder(tokenizer_path)
        for batch in arrow_batches(batches):
            for small in (batch.slice(at, 4000) for at in range(0, batch.num_rows, 4000)):
                ids = small.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                shard = np.searchsorted(bounds, ids, side="right").astype(np.int32)
                tokens = encoder.encode_column(small.column(1), END_TOKEN)
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(shard), tokens], ["doc_id", "shard", "tokens"])

    def build(batches):
        for shard, group in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            ids, lengths, parts, size, part = [], [], [], 0, 0
            for _, doc_id, tokens in group:
                if size and size + len(tokens) // token_bytes > payload_tokens:
                    yield _payload(shard, part, ids, lengths, parts, width)
                    ids, lengths, parts, size, part = [], [], [], 0, part + 1
                ids.append(_NULL_ID if doc_id is None else doc_id)
                lengths.append(len(tokens) // token_bytes)
                parts.append(tokens)
                size += len(tokens) // token_bytes
            yield _payload(shard, part, ids, lengths, parts, width)

    encoded = frame.mapInArrow(encode, "doc_id long, shard int, tokens binary")
    dealt = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tokens")
    dealt.mapInArrow(build, "shard int, part int, n_docs long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def _rows(batches):
    for batch in arrow_batches(batches):
        yield from zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)


def _payload(shard, part, ids, lengths, parts, width) -> pa.RecordBatch:
    tokens = np.frombuffer(b"".join(parts), dtype=width).astype(np.uint32)
    row = {"shard": shard, "part": part, "n_docs": len(ids), "n_tokens": len(tokens), "payload": pack_payload(ids, lengths, tokens)}
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards: doc_id, start (tokens before the document), n_tokens and ids_crc32 of its little-endian 32-bit ids."""
    shards = spark.read.parquet(path)

    def decode(batches):
        for batch in arrow_batches(batches):
            for shard, part, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, lengths, matrix = unpack_payload(payload)
                data, ends = matrix.tokens().astype("<u4").tobytes(), np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(ids), pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(ids, mask=ids == _NULL_ID),
                     pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["shard", "part", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("shard", "part", "payload").mapInArrow(decode, "shard int, part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # The tokens before a payload: those of the shards before, one row each, and of the parts before in its own shard.
    totals = shards.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before_shard"))
    parts = shards.select("shard", "part", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_tokens")).alias("before_part"))
    offsets = parts.join(before, "shard").select("shard", "part", (F.col("before_shard") + F.col("before_part")).alias("offset"))
    return docs.join(offsets, ["shard", "part"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer_path: str, shard_chars: int = SHARD_CHARS, payload_tokens: int = PAYLOAD_TOKENS) -> DataFrame:
    """Write the shards of docs to a fresh folder and read them back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-shards")
    write_shards(docs, tokenizer_path, path, shard_chars, payload_tokens)
    return read_documents(spark, path)
