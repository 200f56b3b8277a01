"""Byte-level BPE with DuckDB recursive queries inside each Spark task.

A text is split by the tokenizer's pattern. The distinct new pieces of a batch become
token-position rows, and one recursive query contracts them: every round joins the rows
of neighbouring tokens with the merge table, takes each piece's leftmost pair of minimum
rank and replaces it by its merge; a piece without a pair drops out, and its shortest
state is its ids. Ids are kept packed as little-endian unsigned 32-bit integers.
Decoding joins the id rows with the vocabulary and puts the bytes together by an
aggregation ordered by position, one block of positions after the other. The result
equals tiktoken's encode_ordinary and decode_bytes.

A piece above ``SHORT`` bytes would need very many rounds of one merge each. It goes
through a second recursive query which contracts all pairs of the minimum rank at once,
leftmost first where they overlap. That is the same as one by one: in a vocabulary whose
tokens all encode to themselves, a pair with the new token never ranks below it. A piece
above ``HUGE`` bytes (one word of that length) leaves DuckDB: its rounds times its length
would take minutes, so the same contraction runs over a heap of pairs, exactly.

With the public pattern a text is cut at its spaces before the pattern is applied, so
that a word's pieces and ids are looked up whole: where the pattern never matches across
a space, it splits both sides alone as it splits them together (see ``cut``).

Memory per task is bounded: a task takes ``SLICE_BYTES`` of texts at once (a longer text
alone) and encodes them in stretches of ``STRETCH`` characters, pieces in blocks by the
rows that their rounds can produce; ids are decoded in blocks of ``IDS`` positions
whatever documents they belong to, and the caches are emptied when what they hold,
counted in bytes, is above ``CACHE_BYTES``.

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows
are encoded alike; a very long text is encoded whole, stretch by stretch; of equal
ranks the leftmost pair wins; an empty table gives an empty result; input columns named
like an output column are replaced, all others pass through.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import add_columns
from wareweave.llm.common import table, whole_text

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a piece up to which its merges are done one a round, and beyond which no query takes it.
SHORT, HUGE = 256, 2048
#: Rows that the rounds of one query may produce, ids in one query, characters in one stretch.
ROWS, IDS, STRETCH = 3_000_000, 200_000, 1 << 20
#: Text bytes that a task handles at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of encoded words, and of pieces, that a worker keeps; those of an entry's objects beside its text and ids.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 180
DUCKDB_MEMORY = "100MB"

ENCODE = """
WITH RECURSIVE step(piece, tokens) AS (
  SELECT piece, tokens FROM start_rows
  UNION ALL
  SELECT s.piece, list_concat(list_append(s.tokens[1:(b.best & 65535) - 1], (b.best >> 16)::INTEGER), s.tokens[(b.best & 65535) + 2:])
  FROM step s JOIN (
    SELECT r.piece, min((m.merged::BIGINT << 16) | r.pos) AS best
    FROM (
      SELECT piece, unnest(tokens[1:-2]) AS token, unnest(tokens[2:]) AS next_token, unnest(range(1, len(tokens))) AS pos
      FROM step
    ) r JOIN merges m ON m.pair = (r.token::BIGINT << 32) | r.next_token
    GROUP BY r.piece
  ) b ON b.piece = s.piece
)
SELECT piece, arg_min(tokens, len(tokens)) AS ids FROM step GROUP BY piece ORDER BY piece
"""
#: Of neighbouring pairs of the minimum rank (a run), every other one is contracted.
ENCODE_LONG = """
WITH RECURSIVE step(piece, tokens, round) AS (
  SELECT piece, tokens, 0 FROM start_rows
  UNION ALL
  SELECT piece, list(CASE WHEN hit THEN best ELSE token END ORDER BY pos), round + 1
  FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY piece ORDER BY pos), false) AS eaten
    FROM (
      SELECT *, lowest AND row_number() OVER (PARTITION BY piece, lowest, run ORDER BY pos) % 2 = 1 AS hit
      FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY piece, lowest ORDER BY pos) AS run
        FROM (
          SELECT *, coalesce(merged = best, false) AS lowest
          FROM (
            SELECT r.*, m.merged, min(m.merged) OVER (PARTITION BY r.piece) AS best
            FROM (
              SELECT piece, round, unnest(tokens) AS token, unnest(list_append(tokens[2:], -1)) AS next_token,
                     unnest(range(1, len(tokens) + 1)) AS pos
              FROM step WHERE round < {rounds}
            ) r LEFT JOIN merges m ON m.pair = (r.token::BIGINT << 32) | r.next_token AND r.next_token >= 0
          ) WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE NOT eaten
  GROUP BY piece, round
)
SELECT piece, arg_max(tokens, round) AS ids, max(round) AS rounds FROM step GROUP BY piece ORDER BY piece
"""
DECODE = "SELECT unhex(string_agg(v.hex, '' ORDER BY i.pos)) AS bytes FROM id_rows i JOIN vocabulary v ON v.token = i.token"


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: A space after white space and not before a word: only there can a match reach over a space's front.
_CLOSE_BLANKS = regex.compile(r"\s (?!\S)").search
_WORD_END = regex.compile(r"(?<=[\p{L}\p{N}]) ").search


def cut(text: str) -> list[str] | None:
    """The words between the spaces of a text, or None where that would part a match.

    A match of the public pattern holds a space only as its first character or within
    white space. White space before a word gives its last space to the word, so a match
    ends before every space but one that follows white space and precedes none.
    """
    return None if _CLOSE_BLANKS(text) else text.split(" ")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about size characters, cut in front of the space after a word."""
    start = 0
    while len(text) - start > size:
        found = _WORD_END(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Cache(dict):
    """Packed ids by text, with the bytes that they take."""

    held = 0

    def add(self, texts: list[str], ids: list[bytes]) -> None:
        self.update(zip(texts, ids, strict=True))
        self.held += ENTRY_BYTES * len(texts) + sum(map(len, texts)) + sum(map(len, ids))

    def empty_if_full(self) -> None:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


class Codec:
    """Merge table and vocabulary in an in-memory DuckDB of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.by_words = pattern == public_tokenizers.PATTERN
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.pieces = Cache()
        self.words = Cache()  # ids of each word with the space before it
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
        self.load("merges", pair=pa.array(pairs, pa.int64()), merged=pa.array(merged, pa.int32()))
        tokens = pa.array(list(ranks.values()), pa.int32())
        self.load("vocabulary", token=tokens, hex=pa.array([t.hex() for t in ranks]))

    def load(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def rows(self, query: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, one merge a round."""
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
        tokens = pa.array(self.single[np.frombuffer(b"".join(pieces), np.uint8)])
        start = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), tokens)
        found = self.rows(ENCODE, "start_rows", piece=np.arange(len(pieces), dtype=np.int32), tokens=start)
        ids = found.column("ids").combine_chunks()
        packed, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
        return [packed[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]

    def contract_long(self, piece: bytes) -> bytes:
        """Packed ids of one long piece, all pairs of the minimum rank a round."""
        tokens, limit = self.single[np.frombuffer(piece, np.uint8)], max(1, ROWS // (8 * len(piece)))
        while True:  # a query holds the states of its rounds, so their number is bounded
            start = pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens))
            found = self.rows(ENCODE_LONG.format(rounds=limit), "start_rows", piece=np.zeros(1, np.int32), tokens=start)
            tokens = found.column("ids").combine_chunks().flatten().to_numpy()
            if found.column("rounds")[0].as_py() < limit:
                return tokens.astype("<u4").tobytes()

    def contract_huge(self, piece: bytes) -> bytes:
        """The same contraction for one huge piece: a heap of pairs by (rank, place)."""
        tokens: list = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        end = [i + 1 for i in range(len(piece))]
        before = [i - 1 for i in range(len(piece))]
        rank = lambda i: self.ranks.get(piece[i : end[end[i]]]) if end[i] < len(piece) else None
        heap = [(r, i, 2) for i in range(len(piece) - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if tokens[i] is None or end[i] >= len(piece) or end[end[i]] - i != size or rank(i) != r:
                continue
            gone = end[i]
            tokens[i], tokens[gone], end[i] = r, None, end[gone]
            if end[i] < len(piece):
                before[end[i]] = i
            for j in (before[i], i):
                if j >= 0 and (q := rank(j)) is not None:
                    heapq.heappush(heap, (q, j, end[end[j]] - j))
        return np.array([t for t in tokens if t is not None], "<u4").tobytes()

    def _encode_pieces(self, new: set[str]) -> None:
        """Put the ids of new pieces into the cache."""
        names: list[str] = []
        block: list[bytes] = []
        rows = 0
        for piece in new:
            raw = piece.encode()
            if (size := len(raw)) > SHORT:
                self.pieces.add([piece], [self.contract_huge(raw) if size > HUGE else self.contract_long(raw)])
                continue
            names.append(piece)
            block.append(raw)
            rows += size * size
            if rows > ROWS:
                self.pieces.add(names, self.contract(block))
                names, block, rows = [], [], 0
        if block:
            self.pieces.add(names, self.contract(block))

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """Packed ids of texts that are split into pieces."""
        self.pieces.empty_if_full()
        self._encode_pieces(set().union(*split).difference(self.pieces))
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in split]

    def _by_words(self, parts: list[str]) -> list[bytes]:
        """Packed ids of stretches of text, looked up word by word."""
        whole: dict[int, list[str]] = {}
        words: dict[int, list[str]] = {}
        for i, part in enumerate(parts):
            if (found := cut(part)) is None:
                whole[i] = self.split(part)
            else:
                whole[i] = self.split(found[0])
                del found[0]
                words[i] = found
        self.words.empty_if_full()
        new = list(set().union(*words.values()).difference(self.words))
        split = [[" " + w] if w.isascii() and w.isalpha() else self.split(" " + w) for w in new]
        heads = self._ids([*whole.values(), *split])
        self.words.add(new, heads[len(whole) :])
        out = heads[: len(whole)]
        for i, found in words.items():
            out[i] += b"".join(map(self.words.__getitem__, found))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, in groups of stretches of bounded length."""
        out: list[list[bytes]] = [[] for _ in texts]
        owner, group, held = [], [], 0
        for i, part in [*((i, p) for i, t in enumerate(texts) for p in (stretches(t) if self.by_words else [t])), (0, None)]:
            if group and (part is None or held + len(part) > STRETCH):
                ids = self._by_words(group) if self.by_words else self._ids([self.split(p) for p in group])
                for o, packed in zip(owner, ids, strict=True):
                    out[o].append(packed)
                owner, group, held = [], [], 0
            if part is not None:
                owner.append(i)
                group.append(part)
                held += len(part)
        return [b"".join(parts) for parts in out]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids, in blocks of positions over all of them."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        data = b"".join(
            self.rows(DECODE, "id_rows", pos=np.arange(len(block), dtype=np.int32), token=block).column("bytes")[0].as_py()
            for block in np.split(ids, range(IDS, len(ids), IDS))
            if len(block)
        )
        counts = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
        ends = np.r_[0, np.cumsum(self.sizes[ids])][np.cumsum(counts)] if len(packed) else []
        starts = [0, *ends[:-1]]
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]


_codecs: dict[tuple[str, str], Codec] = {}


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add ids (packed little-endian uint32) and decoded (the bytes of these ids)."""
    path = path or public_tokenizers.path(RANKS)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # a tokenizer's fixed 50,256 entries

    def work(texts: list[str]) -> list[pa.Array]:
        if (codec := _codecs.get((path, pattern))) is None:
            codec = _codecs[path, pattern] = Codec(ranks.value, pattern)
        ids = codec.encode(texts)
        return [pa.array(ids, pa.binary()), pa.array(codec.decode(ids), pa.binary())]

    added = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return add_columns(docs.withColumn("text", whole_text()), "text", added, work, SLICE_BYTES)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return round_trip(docs.select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def bpe_query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
