"""SentencePiece encoding and decoding with a max-plus parallel scan.

A text is segmented into the vocabulary's pieces so that the sum of their
scores is highest (characters outside the vocabulary become bytes).  Texts of
less than ``GIANT`` characters are encoded by the library where they lie.  A
giant one is cut into chunks, dealt to all workers:

1. each chunk yields a max-plus transfer matrix: entry i, exit j, best score of
   pieces that start in the chunk, when the first starts i characters after its
   beginning and the last ends j characters after its end;
2. the matrices of a document are combined associatively, which gives the best
   state at every boundary;
3. each chunk is backtraced by itself between its two boundary states.

Scores are summed in double precision, exact for the whole numbers that these
vocabularies hold.  The library sums in single precision, so it gets runs of at
most ``RUN`` characters, cut at single spaces, which no piece crosses.  Pieces
that a file scores as never to be merged count as one below the lowest score.

Defined results: a null text has null ids, an empty one none.  U+2581 is the
vocabulary's space and reads back as one.  Of equal segmentations one is
returned, always the same.  Repeated rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK, RUN, TOGETHER = 1 << 16, 1 << 12, 480, 32
#: Most tasks that the chunks of all giants are dealt to.
MOST_TASKS = 16384
SPACE = "▁"
_NONE = -np.inf
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """A vocabulary read for best-score segmentation."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = pb.ModelProto.SentencePiece
        normal = [p for p in proto.pieces if p.type == kind.NORMAL]
        low = min(p.score for p in normal if p.score > -1e8)
        for p in normal:
            p.score = max(p.score, low - 1)
        self.unknown = min(p.score for p in normal) - 10.0
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("models that normalise texts aren't supported")
        proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        self.library = sentencepiece.SentencePieceProcessor()
        self.library.LoadFromSerializedProto(proto.SerializeToString())
        if any(SPACE in p.piece.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with a space inside aren't supported")
        found = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL]
        self.longest = max(len(piece) for _, piece, _ in found)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [(i, piece, s) for i, piece, s in found if len(piece) == n]
            h = np.array([_hash(codes(piece), 0, n) for _, piece, _ in own], np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], np.array([s for *_, s in own])[order], np.array([i for i, *_ in own], np.int64)[order]))

    def edges(self, cps: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces at each of the first ``starts`` characters: (starts, longest).

        Id -1 stands for a character that has no piece.
        """
        score = np.full((starts, self.longest), _NONE)
        ids = np.full((starts, self.longest), -1, np.int64)
        h = np.zeros(len(cps), np.uint64)
        for n, (known, scores, pieces) in enumerate(self.tables, 1):
            if len(cps) < n:
                break
            # the hash of n characters from each position, from that of n - 1
            h = h[: len(cps) - n + 1] * _MUL + cps[n - 1 :] + np.uint64(1)
            m = min(starts, len(h))
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h[:m]), len(known) - 1)
            hit = np.flatnonzero(known[at] == h[:m])
            score[hit, n - 1] = scores[at[hit]]
            ids[hit, n - 1] = pieces[at[hit]]
        score[score[:, 0] == _NONE, 0] = self.unknown
        return score, ids

    def spell(self, piece: int, cp: int) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.bytes[b] for b in chr(cp).encode()] if self.bytes else [self.unk]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _hash(cps: np.ndarray, a: int, b: int) -> np.uint64:
    h = 0
    for c in cps[a:b]:
        h = (h * int(_MUL) + int(c) + 1) % (1 << 64)
    return np.uint64(h)


@lru_cache(4)
def model(path: str) -> Model:
    return Model(path)


# --- the scan ----------------------------------------------------------------


def _forward(scores: np.ndarray, best: np.ndarray, back: np.ndarray | None = None) -> None:
    """Relaxes (chunks, rows, positions) ``best`` along the edges, all chunks a character at a time."""
    k, c, n = scores.shape
    for s in range(c):
        reach = best[:, :, s, None] + scores[:, s, None, :]
        ahead = best[:, :, s + 1 : s + 1 + n]
        better = reach > ahead
        np.copyto(ahead, reach, where=better)
        if back is not None:
            np.copyto(back[:, s + 1 : s + 1 + n], np.broadcast_to(np.arange(1, n + 1, dtype=np.int8), (k, n)), where=better[:, 0])


def _stack(m: Model, texts: list[str], sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    scores = np.full((len(texts), max(sizes), m.longest), _NONE)
    ids, cps = [], []
    for i, (text, size) in enumerate(zip(texts, sizes)):
        cps.append(codes(text))
        scores[i, :size], own = m.edges(cps[-1], size)
        ids.append(own)
    return scores, ids, cps


def transfer(m: Model, texts: list[str], sizes: list[int]) -> np.ndarray:
    """(chunks, L, L) transfer matrices; a text holds its chunk of that size and what pieces may reach beyond."""
    scores, *_ = _stack(m, texts, sizes)
    n = m.longest
    best = np.full((len(texts), n, scores.shape[1] + n + 1), _NONE)
    best[:, np.arange(n), np.arange(n)] = 0
    _forward(scores, best)
    return np.stack([best[i, :, size : size + n] for i, size in enumerate(sizes)])


def backtrace(m: Model, texts: list[str], sizes: list[int], entries: list[int], exits: list[int]) -> list[list[int]]:
    """Ids of the pieces of each chunk between its boundary states."""
    scores, ids, cps = _stack(m, texts, sizes)
    n = m.longest
    best = np.full((len(texts), 1, scores.shape[1] + n + 1), _NONE)
    best[np.arange(len(texts)), 0, entries] = 0
    back = np.zeros((len(texts), best.shape[2]), np.int8)
    _forward(scores, best, back)
    out = []
    for i, (size, entry, leave) in enumerate(zip(sizes, entries, exits)):
        at, found = size + leave, []
        while at > entry:
            n_chars = int(back[i, at])
            at -= n_chars
            found.append((int(ids[i][at, n_chars - 1]), int(cps[i][at])))
        out.append([x for piece, cp in reversed(found) for x in m.spell(piece, cp)])
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of (stacks of) transfer matrices; associative."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def boundary_states(matrices: np.ndarray) -> np.ndarray:
    """State at each of the K + 1 boundaries of a document's chunks, on a best path from 0 to 0."""
    prefix, step = matrices.copy(), 1
    while step < len(prefix):  # inclusive scan by doubling
        prefix[step:] = combine(prefix[:-step].copy(), prefix[step:])
        step *= 2
    states = np.zeros(len(matrices) + 1, np.int64)
    for k in range(len(matrices) - 1, 0, -1):
        states[k] = np.argmax(prefix[k - 1][0] + matrices[k][:, states[k + 1]])
    return states


def scan(m: Model, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of a whole text by the scan, in one place."""
    if not text:
        return []
    t = SPACE + text.replace(" ", SPACE)
    starts = list(range(0, len(t), chunk))
    sizes = [min(chunk, len(t) - a) for a in starts]
    parts = [t[a : a + size + m.longest - 1] for a, size in zip(starts, sizes)]
    matrices = np.concatenate([transfer(m, parts[i : i + TOGETHER], sizes[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)])
    s = boundary_states(matrices).tolist()
    out = []
    for i in range(0, len(parts), TOGETHER):
        j = min(i + TOGETHER, len(parts))
        out += backtrace(m, parts[i:j], sizes[i:j], s[i:j], s[i + 1 : j + 1])
    return [x for ids in out for x in ids]


def _runs(text: str) -> list[str] | None:
    """``text`` cut at single spaces to runs of at most RUN characters; None where it has no such cut."""
    out, a, n = [], 0, len(text)
    while n - a > RUN:
        b = text.rfind(" ", a + 1, a + RUN)
        while b > 0 and (text[b - 1] == " " or text[b + 1] == " " or text[b - 1] == SPACE or text[b + 1] == SPACE):
            b = text.rfind(" ", a + 1, b)
        if b <= 0:
            return None
        out.append(text[a:b])
        a = b + 1
    out.append(text[a:])
    return out


def encode_batch(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of each."""
    runs, owner, slow = [], [], {}
    for i, text in enumerate(texts):
        if not text:
            continue
        cut = _runs(text)
        if cut is None:
            slow[i] = scan(m, text)
        else:
            runs += cut
            owner += [i] * len(cut)
    coded = m.library.encode(runs, num_threads=1) if runs else []
    size = np.bincount(np.array(owner, np.int64), [len(x) for x in coded], len(texts)).astype(np.int64) if runs else np.zeros(len(texts), np.int64)
    flat = np.fromiter((x for ids in coded for x in ids), np.int32, int(size.sum()))
    if slow:
        ends = np.cumsum(size)
        parts, last = [], 0
        for i in sorted(slow):
            parts += [flat[last : ends[i]], np.array(slow[i], np.int32)]
            last = ends[i]
            size[i] = len(slow[i])
        flat = np.concatenate([*parts, flat[last:]])
    return flat, size


# --- Spark -------------------------------------------------------------------


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, pa.int32()))


def _bites(size: list[int], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters."""
    a, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(size):
        yield a, len(size)


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, ids) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64(F.replace("text", F.lit(SPACE), F.lit(" "))))
    small = F.coalesce(F.length("text") < giant, F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in _bites([len(t or "") for t in texts]):
                flat, size = encode_batch(m, [t or "" for t in texts[a:b]])
                ids = _lists(flat, size)
                nulls = [t is None for t in texts[a:b]]
                if any(nulls):
                    ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=pa.array(nulls))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["text_hash"].slice(a, b - a), ids], ["doc_id", "text_hash", "ids"])

    plain = rows.where(small).mapInArrow(run, "doc_id bigint, text_hash bigint, ids array<int>")
    return plain.unionByName(_encode_giants(rows.where(~small), path, chunk))


def _encode_giants(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    n = model(path).longest
    if chunk < n:
        raise ValueError(f"a chunk must hold the longest piece, of {n} characters")
    # cut in one pass: a substring from a late start would read the text from its beginning for each chunk
    parts: Column = F.regexp_extract_all(F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE))), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    cut = rows.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), parts.alias("t"))
    # a chunk and what pieces may reach beyond it
    beyond = lambda x, i: F.struct(F.length(x).alias("size"), F.concat(x, F.coalesce(F.substring(F.get("t", i + 1), 1, n - 1), F.lit(""))).alias("part"))
    cut = cut.select("doc_id", "text_hash", "row", F.posexplode(F.transform("t", beyond)).alias("k", "c"))
    # written once: the row numbers stay, and chunks are spread by their size alone
    chunks = materialize(cut.select("doc_id", "text_hash", "row", "k", "c.size", "c.part"), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                own = batch.slice(a, TOGETHER)
                found = transfer(m, own["part"].to_pylist(), own["size"].to_pylist())
                flat = _doubles(found)
                yield pa.RecordBatch.from_arrays([own["row"], own["k"], flat], ["row", "k", "m"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        mats = np.stack(table["m"].to_pylist()).reshape(-1, n, n)
        s = boundary_states(mats)
        return pa.Table.from_arrays([table["row"], table["k"], pa.array(s[:-1], pa.int32()), pa.array(s[1:], pa.int32())], ["row", "k", "enter", "leave"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                own = batch.slice(a, TOGETHER)
                ids = backtrace(m, *(own[x].to_pylist() for x in ("part", "size", "enter", "leave")))
                lists = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["text_hash"], own["row"], own["k"], lists], ["doc_id", "text_hash", "row", "k", "ids"])

    # by work, not by bytes: a chunk costs far more time than its size suggests
    tasks = max(1, min(-(-chunks.count() // (4 * TOGETHER)), MOST_TASKS))
    spread = chunks.select("row", "k", "size", "part").repartition(tasks, "row", "k")
    moved = spread.mapInArrow(matrices, "row bigint, k int, m array<double>")
    at = moved.groupBy("row").applyInArrow(states, "row bigint, k int, enter int, leave int")
    found = chunks.join(at, ["row", "k"]).repartition(tasks, "row", "k").mapInArrow(traced, "doc_id bigint, text_hash bigint, row bigint, k int, ids array<int>")
    whole = found.groupBy("row", "doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"))
    return whole.select("doc_id", "text_hash", F.flatten(F.transform("x", lambda s: s["ids"])).alias("ids"))


def _doubles(found: np.ndarray) -> pa.ListArray:
    width = found.shape[1] * found.shape[2]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel()))


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """``coded`` (doc_id, text_hash, ids) with the text its ids spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch["ids"]
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            for a, b in _bites(np.diff(offsets).tolist()):
                texts = m.library.decode([values[offsets[i] : offsets[i + 1]].tolist() for i in range(a, b)], num_threads=1)
                text = pa.array([t if v else None for t, v in zip(texts, ids.slice(a, b - a).is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch[x].slice(a, b - a) for x in ("doc_id", "text_hash", "ids")), text], ["doc_id", "text_hash", "ids", "text"])

    return coded.select("doc_id", "text_hash", "ids").mapInArrow(run, "doc_id bigint, text_hash bigint, ids array<int>, text string")


def round_trips(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, same): ids of every row, and whether they spell its text again."""
    back = decode(encode(docs, path), path)
    same = F.when(F.col("text").isNotNull(), F.xxhash64("text") == F.col("text_hash"))
    return back.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "ids", same.alias("same"))
