"""Operator 3: best-fit packing with swap-based local search.

Documents are tokenised, cut into pieces of at most ``size`` tokens, and the pieces are packed into as few
sequences as can be. What packs is decided by lengths alone, so the driver sees one count for each length (at most
``size`` numbers, whatever the input) and plans *patterns*: a multiset of lengths and how many bins have it.

1. Best fit: the longest length left opens a bin; the lengths left that fill it best, in one, two or three pieces
   where they can fill it to the brim, join it, and the pattern is repeated while its lengths last.
2. Local search over the underfull bins: move one piece, exchange one for one, or two for one, from an emptier bin
   to a fuller one, whenever that raises the squared fill; emptied bins vanish.

Pieces then take their places by their rank among those of the same length. Ranks are counted in two levels
(within a task, then over the tasks' counts), so a length that a third of all pieces share isn't gathered anywhere.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.work import map_arrow, stored

SIZE = 2048
#: Fixed value: the pattern of byte-level BPE vocabularies of this family, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """text -> ids, as tokenizers gives with add_special_tokens=False; one for each Python worker.

    A byte-level BPE file whose ids follow its merges is run by tiktoken, which gives the same ids at a multiple of
    the speed; a probe makes sure of it, and any other file is run by tokenizers itself.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = _load(path)
    return _ENCODERS[path]


def _load(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"].get("type", "BPE") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return slow
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)

    def ids(text: str) -> list[int]:
        return fast.encode(text, allowed_special="all") if any(m in text for m in marks) else fast.encode_ordinary(text)

    probe = "It's 12,345 naïve façade über…  \n\n\tfoo_bar  日本語 🙂 can't  x " + "".join(marks) + " ŀ"
    return ids if ids(probe) == slow(probe) else slow


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> its pieces in order; with_ids adds the token ids themselves.

    A document is its ids, then id 0. Only longer ones than size are cut; the first piece takes what is over, all
    others are full. Null text counts as empty and so is one token. part and rank place a piece among those of its
    length that the same task made.
    """

    def cut(batches):
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], dtype="<u4")
                first = (len(ids) - 1) % size + 1
                edges = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    own = ids[a:b]
                    for name, v in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(own.tobytes())), ("rank", seen[b - a]), ("ids", own.tolist() if with_ids else None)):
                        out[name].append(v)
                    seen[b - a] += 1
            made = {
                "doc_id": pa.array(out["doc_id"], pa.int64()), "piece": pa.array(out["piece"], pa.int32()), "start": pa.array(out["start"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()), "ids_crc32": pa.array(out["ids_crc32"], pa.int64()),
                "part": pa.array([part] * len(out["rank"]), pa.int32()), "rank": pa.array(out["rank"], pa.int64()),
            }
            if with_ids:
                made["ids"] = pa.array(out["ids"], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(made)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of bins) that hold counts[length] pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    patterns: list[tuple[tuple[int, ...], int]] = []
    longest = size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return patterns
        own = [longest]
        left[longest] -= 1
        gap = size - longest
        while gap:
            fill = _fill(left, gap)
            if not fill:
                break
            for n in fill:
                left[n] -= 1
            own += fill
            gap -= sum(fill)
        uses = Counter(own)
        more = int(min(left[n] // k for n, k in uses.items()))
        for n, k in uses.items():
            left[n] -= k * more
        patterns.append((tuple(own), more + 1))


def _fill(left: np.ndarray, gap: int) -> list[int]:
    """The best next pieces for a gap: one, two or three that close it, else the longest one that fits.

    Three are looked for among the 64 longest first pieces and 4 second ones for each: that bounds the search for a good
    pattern, and leaves no piece out.
    """
    if left[gap]:
        return [gap]
    lengths = np.flatnonzero(left[:gap])
    if not len(lengths):
        return []
    other = gap - lengths
    two = lengths[(left[other] > 0) & ((other != lengths) | (left[lengths] > 1))]
    if len(two):
        return [int(two[-1]), int(gap - two[-1])]
    for a in lengths[::-1][:64]:
        rest = gap - a
        low = lengths[lengths < rest]
        low = low[(left[rest - low] > 0)]
        for b in low[::-1][:4]:
            if all(left[n] >= k for n, k in Counter((int(a), int(b), int(rest - b))).items()):
                return [int(a), int(b), int(rest - b)]
    return [int(lengths[-1])]


def local_search(patterns: list[tuple[tuple[int, ...], int]], size: int = SIZE, rounds: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """Exchange pieces between underfull bins while the sum of squared fills rises; empty bins go.

    Bins with equal contents move together. A round changes one pair of such groups; rounds bounds the work on the
    driver, and the best fit stands where it ends.
    """
    full = [p for p in patterns if sum(p[0]) == size]
    open_ = Counter()
    for p, n in patterns:
        if sum(p) < size:
            open_[tuple(sorted(p, reverse=True))] += n
    stuck: set[tuple[int, ...]] = set()
    for _ in range(rounds):
        order = sorted((p for p in open_ if p not in stuck), key=lambda p: (-sum(p), p))
        if not order:
            break
        a = order[0]
        found = _exchange(a, open_, size)
        if not found:
            stuck.add(a)
            continue
        b, new_a, new_b = found
        n = open_[a] // 2 if a == b else min(open_[a], open_[b])
        open_.subtract({a: n})
        open_.subtract({b: n})
        for p in (new_a, new_b):
            if p and sum(p) < size:
                open_[p] += n
                stuck.discard(p)
            elif p:
                full.append((p, n))
        open_ = Counter({p: k for p, k in open_.items() if k > 0})
    return full + sorted(open_.items(), key=lambda x: (-sum(x[0]), x[0]))


def _exchange(a: tuple[int, ...], open_: Counter, size: int):
    """The change that fills a most, with an emptier bin: (that bin, a after, that bin after)."""
    gap, fill, best = size - sum(a), sum(a), (0, None)
    for b, n in open_.items():
        if sum(b) > fill or (b == a and n < 2):
            continue
        singles = sorted(set(b))
        gives = [(x, (x,)) for x in singles]
        gives += [(x + y, (x, y)) for i, x in enumerate(singles) for y in singles[i:] if x != y or b.count(x) > 1]
        for back in (0, *sorted(set(a))):
            for total, given in gives:
                gain = total - back
                if best[0] < gain <= gap and sum(b) - gain < fill + gain and (len(given) == 1 or back):
                    best = (gain, (b, given, back))
        if best[0] == gap:
            break
    if not best[1]:
        return None
    b, given, back = best[1]
    new_a, new_b = Counter(a) + Counter(given), Counter(b) - Counter(given)
    if back:
        new_a, new_b = new_a - Counter([back]), new_b + Counter([back])
    return b, tuple(sorted(new_a.elements(), reverse=True)), tuple(sorted(new_b.elements(), reverse=True))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with part and rank (from a stored table) -> the same rows with sequence_id and offset.

    Every piece gets a place; places in a sequence have no gaps and start at 0. Equal pieces are told apart by
    part and rank. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    tallies = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = tallies.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    runs, used, sequence = [], Counter(), 0
    for own, n in local_search(best_fit(counts, size), size):
        offset = 0
        for length in own:
            runs.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    shifts, places = _bucketed(runs)
    lengths = spark.createDataFrame(list(shifts.items()), "length long, shift int")
    places = spark.createDataFrame(places, "length long, bucket long, first long, last long, sequence long, offset long")
    ranked = cut.join(before, ["length", "part"]).withColumn("_rank", F.col("rank") + F.col("before"))
    # the places are as many as the patterns have lengths, which the number of lengths bounds, not the input
    found = ranked.join(F.broadcast(lengths), "length").withColumn("bucket", F.expr("shiftright(_rank, shift)")).join(F.broadcast(places), ["length", "bucket"])
    return found.where("_rank >= first AND _rank < last").select(
        *[c for c in cut.columns if c not in ("part", "rank")], (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def _bucketed(runs: list[tuple[int, int, int, int, int]]) -> tuple[dict[int, int], list[tuple[int, int, int, int, int, int]]]:
    """Runs (length, first, last, sequence, offset) of ranks, filed under buckets of 2 ** shift[length] ranks, about as wide
    as that length's runs are on average: so a rank meets a few runs however many its length has, and the files are at
    most a few times as many as the runs."""
    total, number = Counter(), Counter()
    for length, first, last, _, _ in runs:
        total[length] += last - first
        number[length] += 1
    shifts = {n: int(total[n] // number[n]).bit_length() for n in total}
    return shifts, [(n, k, first, last, sequence, offset) for n, first, last, sequence, offset in runs for k in range(first >> shifts[n], (last - 1 >> shifts[n]) + 1)]


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack docs(doc_id, text). The pieces are written once, so that their ranks stay as they are."""
    return pack(stored(pieces(docs, tokenizer, size, with_ids), "pieces"), size)
