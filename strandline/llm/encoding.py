"""Byte-level BPE of whole corpora: DuckDB recursive queries inside each partition."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the public byte_bpe vocabularies cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in hand at once, and words kept encoded between batches.
CHARS, WORDS = 1_000_000, 200_000
#: Bytes from which a word is contracted by a heap instead of a query, and rows a query's steps may come to.
LONG, ROWS = 256, 4_000_000

_STEP = """
  select *, lag(hit, 1, false) over (partition by w order by p) as gone from (
   select *, coalesce(r = low and (row_number() over (partition by w, r, i - k order by p)) % 2 = 1, false) as hit from (
    select *, case when r = low then row_number() over (partition by w, r order by p) end as k from (
     select x.w, x.step, x.p, x.id, x.i, m.m, m.r, min(m.r) over (partition by x.w) as low from (
       select *, lead(id) over (partition by w order by p) as nxt, row_number() over (partition by w order by p) as i from {rows}) x
     left join merges m on m.a = x.id and m.b = x.nxt) where low is not null))"""
#: Rows are (word, position, token). A step joins each token and its right neighbour with the merge table, finds the
#: word's minimum rank and contracts its occurrences, leftmost first and without overlap; a word without a
#: mergeable pair leaves the recursion.
_PLAIN = f"""with recursive s(w, step, p, id) as (select w, 0, p, id from tok union all
 select w, step + 1, p, case when hit then m else id end from ({_STEP.format(rows="s")}) where not gone)
select w, list(id order by p) as ids from (select *, max(step) over (partition by w) as last from s) where step = last group by w order by w"""
#: Tokens in the order of their places, put together again.
_DECODE = "select d, unhex(string_agg(coalesce(h, 'EFBFBD'), '' order by p)) as raw from tok left join pieces using (id) group by d order by d"


@dataclass(frozen=True)
class Vocabulary:
    """Ids of single bytes, merges (left, right, merged, rank), the bytes of every id, and how text is cut into words."""

    byte_ids: np.ndarray
    merges: np.ndarray
    pieces: dict[int, bytes]
    pattern: str = PATTERN


def load_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS, pattern: str = PATTERN) -> Vocabulary:
    """A public byte-level BPE from ``<name>.tiktoken``: its bytes and ranks.

    Merges are those that ``<name>.json`` lists; where there is no such file, any two tokens whose bytes together are a token
    merge, at that token's rank.
    """
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, f"{name}.tiktoken").read_bytes().splitlines())}
    if (listed := Path(folder, f"{name}.json")).exists():
        model = json.loads(listed.read_text())["model"]
        v = model["vocab"]
        split = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(v[a], v[b], v[a + b], i) for i, (a, b) in enumerate(split)]
    else:
        merges = [(ids[t[:i]], ids[t[i:]], r, r) for t, r in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]
    return Vocabulary(np.array([ids[bytes([i])] for i in range(256)], np.int32), np.array(merges, np.int32).reshape(-1, 4), {i: t for t, i in ids.items()}, pattern)


class Tables:
    """One worker's DuckDB. Nothing it does grows with the corpus: texts, words and steps come in bounded slices."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "600MB", "temp_directory": ""})

    def put(self, name: str, **cols) -> None:
        t = pa.table({k: pa.array(v) for k, v in cols.items()})
        self.db.register("incoming", t)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def get(self, query: str) -> pa.Table:
        return self.db.sql(query).to_arrow_table()


def _places(n: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of groups of ``n``."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Encoder(Tables):
    """The merge table and the words a worker has met."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        super().__init__()
        self.cut, self.bytes, self.merges = regex.compile(vocabulary.pattern).findall, vocabulary.byte_ids, vocabulary.merges
        self.put("merges", **{k: self.merges[:, i] for i, k in enumerate("abmr")})
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = pa.array([], pa.list_(pa.int32()))

    def _contract(self, ids: list[int]) -> list[int]:
        """A long word's merges in order of rank, leftmost first, over a heap: time and memory in proportion to its length."""
        if not self.pairs:
            self.pairs = {(a, b): (r, m) for a, b, m, r in self.merges.tolist()}
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(hit[0], i) for i in range(len(ids) - 1) if (hit := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or (hit := self.pairs.get((ids[i], ids[j]))) is None or hit[0] != rank:
                continue  # changed since
            ids[i], ids[j], after[i] = hit[1], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (hit := self.pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (hit[0], a))
        return [x for x in ids if x >= 0]

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        short = np.flatnonzero(size < LONG)
        part = np.cumsum(size[short] ** 2) // ROWS
        done, out = [], []
        for k in range(int(part.max(initial=-1)) + 1):
            some = short[part == k]
            if len(some):
                n = size[some]
                ids = self.bytes[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]
                self.put("tok", w=np.repeat(some.astype(np.int32), n), p=_places(n).astype(np.int32), id=ids)
                got = self.get(_PLAIN)
                done.append(got["w"].to_numpy())
                out += got["ids"].cast(pa.list_(pa.int32())).chunks
        long = np.flatnonzero(size >= LONG)
        done.append(long)
        out.append(pa.array([self._contract(self.bytes[np.frombuffer(raw[i], np.uint8)].tolist()) for i in long], pa.list_(pa.int32())))
        at = len(self.ids) + np.arange(len(words))
        self.ids = pa.concat_arrays([self.ids, *out])
        self.known.update(zip((words[i] for i in np.concatenate(done)), at.tolist(), strict=True))

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list of ids per text; empty for NULL and empty texts."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > WORDS:
            self._forget()
        if new := list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known)):
            self._learn(new)
        known = self.known
        n = np.array([len(ws) for ws in cut], np.int64)
        words = self.ids.take(pa.array(np.fromiter((known[w] for ws in cut for w in ws), np.int64, int(n.sum()))))
        ends = words.offsets.to_numpy()[np.r_[0, np.cumsum(n)]]
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), words.flatten())


class Decoder(Tables):
    """The bytes of every id."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.put("pieces", id=pa.array(list(vocabulary.pieces), pa.int32()), h=[b.hex() for b in vocabulary.pieces.values()])

    def decode(self, ids: pa.Array) -> list[str | None]:
        """The text of each list of ids; NULL for NULL, empty for an empty list; an unknown id is a replacement character."""
        n = np.array(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.put("tok", d=np.repeat(np.arange(len(n), dtype=np.int32), n), p=_places(n).astype(np.int32), id=ids.flatten().cast(pa.int32()))
        got = self.get(_DECODE)
        out: list[str | None] = ["" if v else None for v in ids.is_valid().to_pylist()]
        for d, raw in zip(got["d"].to_pylist(), got["raw"].to_pylist(), strict=True):
            out[d] = raw.decode("utf-8", "replace")
        return out


def _slices(chars: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(chars):
        if held and held + n > CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(chars):
        yield slice(start, len(chars))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """More partitions for CPU-heavy work, where the files give fewer than the cores can share; large inputs are not shuffled."""
    want = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, *keys)


def encode(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(key, ids array<int>): the ids of each text, without special tokens.

    Words are cut from the text and each distinct word of a partition is encoded once, by a
    recursive query over (word, position, token) rows; words of ``LONG`` bytes and more, whose steps would grow with the square of their
    length, by a heap over their pairs. The words' ids then follow in the order of the text. Control words of tokenizers are ordinary text. NULL and empty texts give an empty
    list. Every row gives a row, repeated keys included; other columns are ignored. No
    shuffle of ids: rows stay in their partition, texts in slices of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())  # some 600 kB, fixed by the vocabulary

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in parts:
            texts = batch.column(1).to_pylist()
            for s in _slices([len(t or "") for t in texts]):
                enc = enc or Encoder(shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], enc.encode(texts[s])], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str, ids: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(key, text): the texts that lists of ids stand for.

    The tokens' bytes are put together by an ordered aggregation over (text, place, id) rows. NULL gives NULL, an empty list an empty text, an
    id outside the vocabulary a replacement character; bytes that are no UTF-8 too. Every row gives a row.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = None
        for batch in parts:
            lists = batch.column(1)
            for s in _slices(lists.value_lengths().fill_null(0).to_pylist()):
                dec = dec or Decoder(shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array(dec.decode(lists[s.start : s.stop]), pa.string())], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
