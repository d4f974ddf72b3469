"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by doc_id, encoded, and packed into shards of about
`SHARD_TOKENS` ids (a longer document has a shard to itself, whole). A shard is a row of a Parquet
table: any store that Spark can write holds it, Spark's commit protocol keeps one copy when tasks
are run again, and readers need no local files.

A shard's `payload` is raw little-endian unsigned ids, 2 bytes each where the vocabulary allows it,
else 4. Its `index` maps keys to places by hash and displace: a key's hash names a bucket, the
bucket's displacement leads to a slot, and the slot holds a 32-bit fingerprint of the key, the start
and the number of ids. There are as many slots as keys. A read costs the same at any shard size; a
key that isn't there is told by its fingerprint, except once in 2**32 times.

The tokenizer neither joins nor splits across white space, and where it keeps letters, digits and
marks apart, not across a change from one to another in ASCII either. So a text's ids are those of
such pieces in order. Array code cuts some MB of text into pieces and makes them distinct; a piece is
encoded once per worker, many at a time with a control character between them, and kept in a bounded
table. Tests compare with the ids of whole texts.

Defined cases: null text is empty and yields the end id alone; null doc_id sorts first; rows with
equal doc_id are keys with ordinals 0, 1, ... in the order of their text's hash and text, counted on
by `lookup` where tasks share a doc_id; a text of any length is one document, up to the 2 GB of a cell; an empty
table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, read, tidy
from ._words import LOWER, SPACE, U64, mix, utf8

SHARD_TOKENS = 1 << 18
CACHED_PIECES = 1_000_000
PART_BYTES = 8 << 20
BREAK = b"\x01"  # words that hold it are encoded one by one
MARKS = b"!\"#$%&'()*+,-./:;=?@[]^_`{|}~"
KIND_RIGHT = np.zeros(256, np.uint8)  # ASCII letters 1, digits 2, marks 3; a piece begins where the kind changes
KIND_RIGHT[[*range(65, 91), *range(97, 123)]] = 1
KIND_RIGHT[48:58] = 2
KIND_RIGHT[list(MARKS)] = 3
KIND_LEFT = KIND_RIGHT.copy()
KIND_LEFT[ord("'")] = 0  # 's is one token
END_ID = 1
SHARDS = "pid int, seq int, first_id long, last_id long, start long, n_docs int, n_tokens long, width int, keys binary, payload binary, index binary"
ROWS = "doc_id long, pid int, local_start long, n_tokens long, ids_crc32 long"
STEP = U64(0x9E3779B97F4A7C15)
DIRECT = np.uint32(1 << 31)


def key_hashes(ids: np.ndarray, ordinals: np.ndarray, null: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(U64) + U64(0x51ED270B)) + ordinals.astype(U64) * STEP + null.astype(U64))


def build_index(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """n u32 | buckets u32 | displacements u32[] | fingerprints u32[] | starts u64[] | counts u64[]."""
    n = len(hashes)
    nb = max(1, (n + 2) // 3)
    bucket = ((hashes >> U64(32)) % U64(nb)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=nb)
    first = np.concatenate(([0], np.cumsum(size)))
    shift, place, free = np.zeros(nb, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    tries = np.arange(64, dtype=U64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own, low = order[first[b] : first[b + 1]], U64(0)
        while True:
            at = (mix(hashes[own][:, None] + (tries + low)[None, :] * STEP) % U64(n)).astype(np.int64)
            good = free[at].all(0)
            for c in np.flatnonzero(good):
                if len(set(at[:, c].tolist())) == len(own):
                    shift[b], place[own] = int(low) + c, at[:, c]
                    free[at[:, c]] = False
                    break
            else:
                low += U64(64)
                if low > U64(1 << 30):
                    raise ValueError("equal key hashes")
                continue
            break
    single = np.flatnonzero(size == 1)
    left = np.flatnonzero(free)[: len(single)]
    shift[single] = left.astype(np.uint32) | DIRECT
    place[order[first[single]]] = left
    marks, begin, count = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    marks[place], begin[place], count[place] = hashes.astype(np.uint32), starts, counts
    return np.array([n, nb], "<u4").tobytes() + shift.astype("<u4").tobytes() + marks.tobytes() + begin.tobytes() + count.tobytes()


def find(index: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: whether its fingerprint is there, start, count."""
    n, nb = (int(x) for x in np.frombuffer(index, "<u4", 2))
    shift = np.frombuffer(index, "<u4", nb, 8)
    marks = np.frombuffer(index, "<u4", n, 8 + 4 * nb)
    begin = np.frombuffer(index, "<u8", n, 8 + 4 * nb + 4 * n)
    count = np.frombuffer(index, "<u8", n, 8 + 4 * nb + 12 * n)
    d = shift[((hashes >> U64(32)) % U64(nb)).astype(np.int64)]
    slot = (mix(hashes + d.astype(U64) * STEP) % U64(n)).astype(np.int64)
    slot = np.where(d & DIRECT, (d & ~DIRECT).astype(np.int64), slot)
    return marks[slot] == hashes.astype(np.uint32), begin[slot].astype(np.int64), count[slot].astype(np.int64)


class WordIds:
    """Pieces of words and their ids, in Arrow and numpy; emptied when it holds `CACHED_PIECES` pieces."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.lowers = '"Lowercase"' in tokenizer_json.split('"pre_tokenizer"')[0]
        self.classes = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in tokenizer_json  # letters, digits and marks are never in one token, but for 's and the like
        cut = self._ids(BREAK.decode())
        self.cut = cut[0] if len(cut) == 1 and self._ids(f"a {BREAK.decode()} b") == self._ids("a") + cut + self._ids("b") else None
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self._empty()

    def _empty(self) -> None:
        self.pieces, self.ids = pa.array([], pa.binary()), np.zeros(0, self.kind)
        self.begin = self.size = np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cuts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, A-Z lowered where the tokenizer lowers anyway; which are in words; which begin a piece.

        Texts that may hold a special token are neither lowered nor cut within words.
        """
        solid = ~SPACE[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edge = at[at < len(raw)]
        first[edge] = solid[edge]
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        texts = np.ones(len(at) - 1, bool)
        texts[np.searchsorted(at, special, "right") - 1] = False
        usual = np.repeat(texts, np.diff(at)) if len(special) else None
        if self.classes:
            left, right = KIND_LEFT[raw[:-1]], KIND_RIGHT[raw[1:]]
            within = (left != right) & (left > 0) & (right > 0)
            first[1:] |= within if usual is None else within & usual[1:]
        if self.lowers:
            raw = LOWER[raw] if usual is None else np.where(usual, LOWER[raw], raw)
        return raw, solid, first

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and n+1 offsets into them."""
        raw, at = utf8(column)
        raw, solid, first = self.cuts(raw, at)
        starts, data = np.flatnonzero(first), raw[solid]
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(at), np.int64)
        edges = np.append(np.flatnonzero(first[solid]), len(data)).astype(np.int32)
        coded = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]))
        which = self.places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.size[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(self.begin[which] - upto[:-1], n) + np.arange(upto[-1])], upto[np.searchsorted(starts, at)]

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where each piece is in the table; new ones are encoded and put there."""
        at = pc.index_in(distinct, value_set=self.pieces)
        if len(self.pieces) + at.null_count > CACHED_PIECES:
            self._empty()
            at = pc.index_in(distinct, value_set=self.pieces)
        out = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if at.null_count:
            new = distinct.filter(pc.is_null(at))
            out[out < 0] = len(self.pieces) + np.arange(len(new))
            ids = self._encoded(new.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), self.kind)))
            self.pieces = pa.concat_arrays([self.pieces, new])
        return out

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The bytes of each one's ids; what may hold `BREAK` or a special token goes to the tokenizer alone."""
        odd = [w for w in words if self.cut is None or BREAK in w or b"<|" in w]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)]
        known = {w: np.asarray(x, self.kind).tobytes() for w, x in zip(odd, found, strict=True)}
        plain = [w for w in words if w not in known]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            known.update(zip(part, self._joined(part), strict=True))
        return [known[w] for w in words]

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """One call for many words: `BREAK` stands between them, and its id shows where the next begins."""
        text = (b" " + BREAK + b" ").join(words).decode("utf-8", "replace")
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cuts, data, width = np.flatnonzero(ids == self.cut), ids.tobytes(), ids.itemsize
        if len(cuts) != len(words) - 1:
            raise ValueError("the tokenizer doesn't keep words apart")
        return [data[low:high] for low, high in zip([0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(data)], strict=True)]


_CODERS: dict[int, WordIds] = {}


def _coder(tokenizer_json: str) -> WordIds:
    """One for each worker process and tokenizer."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _CODERS:
        _CODERS[key] = WordIds(tokenizer_json)
    return _CODERS[key]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about `PART_BYTES` of text, a longer text alone; the more, the fewer look-ups of equal words."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        limit = (ends[low - 1] if low else 0) + PART_BYTES
        high = max(low + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def _packed(batches: Iterator[pa.RecordBatch], tokenizer_json: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    coder = _coder(tokenizer_json)
    width, tail = np.dtype(coder.kind).itemsize, np.asarray([end_id], coder.kind).tobytes()
    pid, seq, start = TaskContext.get().partitionId(), 0, 0
    docs, ids, counts, ords = [], [], [], []
    last, ordinal = object(), 0

    def shard() -> pa.RecordBatch:
        null = np.array([x is None for x in docs], np.uint8)
        keys = np.array([x or 0 for x in docs], "<i8")
        order, n = np.array(ords, "<u4"), np.array(counts, np.int64)
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        index = build_index(key_hashes(keys, order, null), begin, n)
        row = (pid, seq, docs[0], docs[-1], start, len(docs), int(n.sum()), width, keys.tobytes() + order.tobytes() + null.tobytes(), b"".join(ids), index)
        names = [x.split()[0] for x in SHARDS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    held = 0
    for batch in batches:
        for part in _parts(batch):
            found, at = coder.encode(part.column(1))
            for doc, low, high in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                data = found[low:high].tobytes() + tail
                n = len(data) // width
                if docs and held + n > shard_tokens:
                    yield shard()
                    seq, start = seq + 1, start + held
                    docs, ids, counts, ords, held = [], [], [], [], 0
                ordinal = ordinal + 1 if doc == last else 0
                last = doc
                docs.append(doc), ids.append(data), counts.append(n), ords.append(ordinal)
                held += n
    if docs:
        yield shard()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes (doc_id, text) into shards at `path`, in ascending doc_id order."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of fixed size beside the program
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    out = rows.mapInArrow(tidy(lambda it: _packed(it, tokenizer.value, end_id, shard_tokens)), SHARDS)
    out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", 64).parquet(path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = {k: batch.column(k)[row].as_py() for k in ("pid", "start", "n_docs", "n_tokens", "width", "keys", "payload", "index")}
            n = r["n_docs"]
            keys, order, null = np.frombuffer(r["keys"], "<i8", n), np.frombuffer(r["keys"], "<u4", n, 8 * n), np.frombuffer(r["keys"], np.uint8, n, 12 * n)
            known, begin, count = find(r["index"], key_hashes(keys, order, null))
            if not known.all() or len(r["payload"]) != r["n_tokens"] * r["width"]:
                raise ValueError("a shard's index doesn't fit its payload")
            ids = np.frombuffer(r["payload"], f"<u{r['width']}")
            crcs = [zlib.crc32(ids[b : b + c].astype("<u4").tobytes()) for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(np.full(n, r["pid"], np.int32)), pa.array(begin + r["start"]), pa.array(count), pa.array(crcs, pa.int64()),
            ], ["doc_id", "pid", "local_start", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("pid").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    run = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pid", F.coalesce(F.sum("n").over(run), F.lit(0).cast("long")).alias("before"))
    rows = shards.select("pid", "start", "n_docs", "n_tokens", "width", "keys", "payload", "index").mapInArrow(tidy(_unpacked), ROWS)
    return rows.join(parts, "pid").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int | None, ordinal: int = 0) -> list[int] | None:
    """The ids of one document; the ranges of the shards' keys prune all shards but those that may hold it."""
    shards = spark.read.schema(SHARDS).parquet(path)
    near = F.col("first_id").isNull() if doc_id is None else (F.col("last_id") >= doc_id) & (F.coalesce(F.col("first_id"), F.lit(-(1 << 63))) <= doc_id)
    before, here, pid = 0, 0, None  # rows of this doc_id in earlier partitions, in this one
    for r in shards.filter(near).orderBy("pid", "seq").toLocalIterator():
        if r["pid"] != pid:
            before, here, pid = before + here, 0, r["pid"]
        if ordinal < before:
            return None
        key = key_hashes(np.array([doc_id or 0]), np.array([ordinal - before]), np.array([doc_id is None]))
        known, begin, count = find(r["index"], key)
        if known[0]:
            return np.frombuffer(r["payload"], f"<u{r['width']}")[begin[0] : begin[0] + count[0]].tolist()
        n = r["n_docs"]
        null = np.frombuffer(r["keys"], np.uint8, n, 12 * n).astype(bool)
        here += int((null if doc_id is None else ~null & (np.frombuffer(r["keys"], "<i8", n) == doc_id)).sum())
    return None


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the shards to a folder of its own and reads them back."""
    path = Workspace(docs.sparkSession, "tokens").path("shards")
    write(docs, path, tokenizer_path)
    return read_back(docs.sparkSession, path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), tokenizer_path())
