"""Spelling variants by permuterm rotations.

A word marked with a terminator has one rotation for each of its places. A rotation that ends with the edited character, without that
character, is a prefix that all words share which differ only there; a word that lacks the character altogether has this prefix
as a whole rotation. So replacements and indels become ranges of equal prefixes in the sorted rotations, and a scan of each range emits the
neighbours. A range has one word for each character of the alphabet and one without it at most, whatever the corpus, so no range is
hot and none needs a cap.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

END = "\x00"  # terminator: sorts before any letter and is in no word
LEAST_LENGTH, LEAST_COUNT = 7, 2
TYPO = 31  # a run whose checksum this divides loses a character
RATIO = 10  # a form is at least so many times as frequent
HELD = 200_000  # different words that a task holds before it passes its counts on


def typed(run: str, h: int) -> str:
    """The run as it counts: without one code point where TYPO divides its checksum."""
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % TYPO == 0 else run


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): words of at least ``least_length`` code points that occur ``least_count`` times or more in all texts.

    Words are maximal runs of the letters A to Z and U+00C0 to U+00FF, only A to Z in lower case, after typed(). Null texts have none; a null
    key counts as an empty one in the checksum. Counts are summed in the task first, so a frequent word is one row a task."""
    # A shorter run can't give a word that is long enough. A match starts where its run does, as it would be longer otherwise.
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc, t in zip(b.column("key").to_pylist(), b.column("t"), strict=True):
                lowered = (t.as_py() or "").encode().lower().decode()  # bytes: A to Z only
                begun = zlib.crc32(f"{doc or ''}:".encode())
                for run, n in Counter(runs.findall(lowered)).items():
                    word = typed(run, zlib.crc32(run.encode(), begun))
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, near, near_n) for each ordered pair of different words of ``words`` (word, n; each word once) that one inserted, deleted or
    replaced code point turns into each other. Words must not hold the terminator; the empty word is near all of one letter."""
    size = F.char_length("word")
    cut = F.explode(F.sequence(F.lit(0), size)).alias("i")
    turned = words.select("word", "n", cut).select("word", "n", "i", F.concat(F.expr("substring(word, i + 1)"), F.lit(END), F.expr("substring(word, 1, i)")).alias("rotation"))
    # Of a run of equal letters, only the first counts as inserted: so each indel is met once.
    first = F.expr("i = 1 OR substring(word, i, 1) <> substring(word, i - 1, 1)")
    whole = F.struct(F.col("rotation").alias("prefix"), F.lit(False).alias("edited"), F.lit(True).alias("first"))
    edited = F.struct(F.expr("substring(rotation, 1, char_length(word))").alias("prefix"), F.lit(True).alias("edited"), first.alias("first"))
    entries = F.when(F.col("i") > 0, F.array(whole, edited)).otherwise(F.array(whole))
    rows = turned.select("word", "n", F.explode(entries).alias("e")).select("e.prefix", F.struct("e.edited", "e.first", "word", "n").alias("entry"))
    ranges = rows.groupBy("prefix").agg(F.collect_list("entry").alias("r")).filter((F.size("r") > 1) & F.exists("r", lambda e: e["edited"]))

    def meet(a: Column, b: Column) -> Column:
        replaced = a["edited"] & b["edited"] & (a["word"] != b["word"])
        return replaced | ((a["edited"] != b["edited"]) & a["first"] & b["first"])

    found = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: meet(a, b)), lambda b: F.struct(a["word"].alias("word"), b["word"].alias("near"), b["n"].alias("near_n")))))
    return ranges.select(F.explode(found).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for ``forms`` (word, form), each word once and no form null: the last word that forms lead to. A round follows as
    many steps as all before it together, so rounds grow with the logarithm of the longest chain."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(at.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.filter("moved").limit(1).count() == 0:
            return new.select("word", "root")
        at = new.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) for ``words`` (word, n; each word once).

    n_near counts the words that are near; form is the near word of largest n, of equal ones the least, if it is at least ``ratio`` times
    as frequent; root follows forms to the last, or is the word itself. Null words are left out, an empty table gives an empty result.
    Further columns are dropped."""
    with scratch():
        words = materialize(words.filter("word IS NOT NULL").select("word", "n"), "words")
        best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
        near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        known = words.join(near, "word", "left").withColumn("__is", -F.col("best.minus") >= ratio * F.col("n"))
        known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("__is"), F.col("best.near")).alias("form"), F.when(F.col("__is"), -F.col("best.minus")).cast("long").alias("form_n"))
        known = materialize(known, "known", keep=True)
        root = materialize(roots(known.filter("form IS NOT NULL")), "root", keep=True)
    return known.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))
