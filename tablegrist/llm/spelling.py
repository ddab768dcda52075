"""Spelling variants: words that differ by one character, by a dictionary of pairs
of trie nodes.

All words are kept in two tries, one of the words and one of the reversed words,
whose nodes are numbered. A node of the first stands for a beginning, one of the
second for an ending. Leaving out the character at a position of a word leaves a
pair of nodes; a gap at a position of a word is a pair, too. Two words have a pair
of the first kind in common exactly if they differ in the one character left out;
a word's gap is another word's left-out character exactly if that one has one
character more. So exact neighbours are an equi-join of integer pairs, and a pair
is shared by no more words than there are letters, and one gap.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.reuse import compacted
from tablegrist.llm.tidy import tidy
from tablegrist.session import cut_lineage

#: What a word is made of; only A-Z are lower-cased.
WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One run in so many of a document has a character deleted by the contract.
DAMAGED = 97
#: Distinct words a task counts before it passes them on.
COUNTED_WORDS = 300_000
#: Characters of a text in which words are sought at once.
WINDOW = 1 << 22
#: Nodes up to this depth are numbered by their letters, seven bits each; the
#: words below one node of this depth are numbered by one task, in sorted order.
SHALLOW = 8
_DEEP = 1 << 62
_TASK_BITS = 38


def damaged(doc_id: int | None, word: str, one_in: int = DAMAGED) -> str:
    """``word``, or for one in ``one_in`` pairs of document and word the word
    without one of its characters. A document without an id counts as ''."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text in lower case, window by window; a run that
    goes over the end of a window is left for the next one."""
    at = 0
    while at < len(text):
        to = min(at + WINDOW, len(text))
        while to < len(text) and WORD.match(text[to]):
            to += 1
        yield WORD.findall(text[at:to].translate(_LOWER))
        at = to


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = DAMAGED) -> DataFrame:
    """``word`` and ``n``, its occurrences over all rows. Words are counted within
    tasks first, so a frequent one is a few rows of the shuffle. Null texts and
    texts without a letter have no words; repeated rows count each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc_id, cell in zip(batch.column("id").to_pylist(), batch.column("text")):
                own: Counter[str] = Counter()
                for words in runs(cell.as_py() or ""):
                    own.update(words)
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), head)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    found[word] += n
                if len(found) >= COUNTED_WORDS:
                    yield _counts(found)
                    found.clear()
        yield _counts(found)

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"]
    )


def _letters(word: str) -> np.ndarray:
    """Numbers from 1 to 90 of a-z and U+00C0 to U+00FF."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(c < 0xC0, c - 96, c - 0xC0 + 27)


def _nodes(words: DataFrame, spelled: Column, name: str) -> DataFrame:
    """``word`` and ``name``, the packed numbers of the trie nodes on its path,
    from the root on, when words are spelled as ``spelled``.

    Shallow nodes are numbered by their letters. What lies below one shallow node
    comes to one task in sorted order; there a word shares with the one before it
    the nodes of their common beginning, and its other nodes are new and take the
    next numbers. A task holds one path at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _DEEP | TaskContext.get().partitionId() << _TASK_BITS
        last, path = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            out = []
            for cell in batch.column("spelled"):
                letters = _letters(cell.as_py())
                least = min(len(letters), len(last))
                differ = np.flatnonzero(letters[:least] != last[:least])
                common = int(differ[0]) if len(differ) else least
                here = np.empty(len(letters) + 1, np.int64)
                here[: common + 1] = path[: common + 1]
                for d in range(common + 1, min(SHALLOW, len(letters)) + 1):
                    here[d] = here[d - 1] << 7 | letters[d - 1]
                deep = max(common, SHALLOW) + 1
                if deep <= len(letters):
                    n = len(letters) + 1 - deep
                    here[deep:] = np.arange(new, new + n)
                    new += n
                out.append(here.tobytes())
                last, path = letters, here
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.binary())], ["word", name])

    spelled = words.select("word", spelled.alias("spelled"))
    placed = spelled.repartition(F.substring("spelled", 1, SHALLOW)).sortWithinPartitions("spelled")
    return placed.mapInArrow(tidy(run), f"word string, {name} binary")


#: Kinds of pairs: a left-out character, and a gap between two characters.
_SKIP, _GAP = 0, 1


def _pairs(words: DataFrame) -> DataFrame:
    """A row per word (``id``, ``n``) and position: the pair of nodes (``front``,
    ``back``) that a left-out character or a gap leaves. ``first`` is false where
    leaving out the character before gives the same rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fronts, backs, kinds, first = [], [], [], [], []
            for cell, f, b in zip(batch.column("word"), batch.column("forward"), batch.column("reverse")):
                letters = _letters(cell.as_py())
                front = np.frombuffer(f.as_buffer(), np.int64)
                back = np.frombuffer(b.as_buffer(), np.int64)[::-1]
                n = len(letters)
                fronts += [front[:n], front]
                backs += [back[1:], back]
                kinds += [np.full(n, _SKIP, np.int8), np.full(n + 1, _GAP, np.int8)]
                first += [np.diff(letters, prepend=0) != 0, np.ones(n + 1, bool)]
                sizes.append(2 * n + 1)
            if sizes:
                of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                made = [pa.array(np.concatenate(x)) for x in (fronts, backs, kinds, first)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(of), batch.column("n").take(of), *made],
                    ["id", "n", "front", "back", "kind", "first"],
                )

    return words.mapInArrow(tidy(run), "id bigint, n bigint, front bigint, back bigint, kind tinyint, first boolean")


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``near_n`` for all ordered pairs of distinct words
    (``word``, ``n``, each word once, of a-z and U+00C0 to U+00FF) that differ by
    exactly one inserted, deleted or replaced character. Each pair comes once.

    A word is known by the number of the node its path ends in until all pairs
    are found, so long words are not copied for each of their positions."""
    words = compacted(words.select("word", "n"))
    forward = _nodes(words, F.col("word"), "forward")
    reverse = _nodes(words, F.reverse("word"), "reverse")
    # Numbers hold for one run of the numbering only, so they are written once.
    known = cut_lineage(words.join(forward, "word").join(reverse, "word").select("word", "n", _last("forward").alias("id"), "forward", "reverse"))
    pairs = cut_lineage(_pairs(known))
    skips = pairs.filter(F.col("kind") == _SKIP)
    one = skips.select("front", "back", "id")
    other = skips.select("front", "back", F.col("id").alias("near"))
    replaced = one.join(other, ["front", "back"]).filter("id <> near").select("id", "near")
    longer = skips.filter("first").select("front", "back", F.col("id").alias("long"))
    shorter = pairs.filter(F.col("kind") == _GAP).select("front", "back", F.col("id").alias("short"))
    moved = longer.join(shorter, ["front", "back"]).select(
        F.inline(F.array(
            F.struct(F.col("long").alias("id"), F.col("short").alias("near")),
            F.struct(F.col("short").alias("id"), F.col("long").alias("near")),
        ))
    )
    names = known.select("id", "word")
    near = known.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = replaced.unionByName(moved).withColumnRenamed("near", "near_id")
    return both.join(names, "id").join(near, "near_id").select("word", "near", "near_n")


def _last(nodes: str) -> Column:
    """The last of packed node numbers."""
    mirrored = F.substring(nodes, -8, 8)
    # Packed little end first.
    return F.conv(
        F.concat(*[F.hex(F.substring(mirrored, k, 1)) for k in range(8, 0, -1)]), 16, -10
    ).cast("bigint")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each row of
    ``words`` (``word``, ``n``).

    A word's form is its near word with the largest ``n``, of equal ones the
    smallest in code-point order, if that is at least ``times`` (2 or more) its own
    ``n``. Counts at least double along forms, so following them ends. Rows without
    a word or count are left out; an empty table gives no rows."""
    if times < 2:
        raise ValueError("forms need at least twice the count of a word")
    words = compacted(words.filter("word is not null and n is not null").select("word", "n"))
    near = neighbours(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    best_n = -F.col("best.less")
    enough = best_n >= times * F.col("n")
    formed = compacted(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, best_n).alias("form_n"),
        )
    )
    return formed.join(_roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(formed: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words with a form. Each round doubles the
    steps that are followed."""
    steps = compacted(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = compacted(
            steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, one_in: int = DAMAGED
) -> DataFrame:
    """``variants`` of the words of ``docs`` with at least ``shortest`` code points
    and ``least`` occurrences, after ``damaged``. Null and blank texts have no
    words, ids may be null or repeat, texts and words may be of any length, other
    columns are not read; an empty table gives no rows."""
    words = counted_words(docs, key, text, one_in)
    return variants(words.filter((F.length("word") >= shortest) & (F.col("n") >= least)))
