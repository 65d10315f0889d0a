"""What the operators of this subpackage share: reading, written tables, joins that deal hot keys, native helpers for arrays and spans."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.plans.tables import shared_dir, table  # noqa: F401 - table is what the operators read by

#: The white space that separates words, and its complement, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for btrim().
SPACES = " \t\n\x0b\x0c\r"


class Saved:
    """A table written below the shared folder, which cuts lineage and outlives a lost executor. drop() deletes it; what is left goes when the driver ends."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessel-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self._quietly)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quietly(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may have ended before; nothing is left to delete through it
            pass


SALTS = 64


def dealt_join(rows: DataFrame, keys: list[str], values: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with values, which has a row for each of the keys that stay. A key's rows are dealt over SALTS tasks by the column spread.

    What meets first are values and the (key, salt) that occur, of which a key has SALTS at most, whatever share of the rows it holds.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(salted.select(*keys, "_salt").distinct().join(values, keys), [*keys, "_salt"], how).drop("_salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda's variable is bound, not substituted."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array of strings."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def prefix_scan(values: Column, combine: Callable[[Column, Column], Column], block: int = 512) -> Column:
    """Exclusive prefix results of an associative combine over an array of longs, whose neutral start is 0, by blocks, so that appending costs n * block at most."""
    zero = F.lit(0).cast("long")

    def scan(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def over(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(block)), lambda s: F.slice(xs, s, block))
        return let(cut, lambda blocks: let(
            scan(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), zero),
            lambda offsets: F.flatten(F.transform(blocks, lambda b, i: F.slice(scan(b, F.get(offsets, i)), F.lit(1), F.size(b)))),
        ))

    return let(values, lambda xs: F.when(F.size(xs) > 0, over(xs)).otherwise(F.array().cast("array<bigint>")))


def prefix_sums(values: Column) -> Column:
    return prefix_scan(values, lambda a, x: a + x)


SPAN = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"
#: Code points beside a match in which its context is looked for.
CONTEXT = 200
EDGES = "\"'()[]{}<>,;:!?."


def no_spans() -> Column:
    return F.array().cast(SPAN)


def bare(word: Column) -> Column:
    """A word without punctuation at its ends."""
    return F.btrim(word, F.lit(EDGES))


def regex_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, when: Column | None = None, context: bool = False) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, value, left, right), in code points, without Python.

    Java's split() and find() agree on the matches, so the text between matches and the matches give the positions. pattern must
    not match the empty string. keep: of a match's text, whether it stays. when: a cheap test that a text can hold a match.
    context: whether to give the bare lower-case words beside the match, up to two on the left and one on the right; else they are null.
    """
    size = lambda s: F.char_length(s).cast("long")

    def spans(found: Column, between: Column) -> Column:
        previous = lambda i: F.when(i > 0, F.get(found, i - 1))
        steps = F.transform(found, lambda m, i: size(F.get(between, i)) + F.coalesce(size(previous(i)), F.lit(0).cast("long")))
        before = lambda i: F.right(F.concat(F.coalesce(previous(i), F.lit("")), F.get(between, i)), F.lit(CONTEXT))
        after = lambda i: F.left(F.concat(F.get(between, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(CONTEXT))
        words = lambda x: F.lower(F.array_join(F.transform(F.split(x, SPACE), bare), " "))
        none = F.lit(None).cast("string")
        left = lambda i: words(F.regexp_extract(before(i), rf"((?:[^\x20\x09-\x0D]++{SPACE}+)?[^\x20\x09-\x0D]++){SPACE}$", 1)) if context else none
        right = lambda i: words(F.regexp_extract(after(i), rf"^{SPACE}({WORD})", 1)) if context else none
        # the start of match i is the sum of steps 0..i
        return let(steps, lambda st: let(prefix_sums(st), lambda sums: F.transform(found, lambda m, i: let(F.get(sums, i) + F.get(st, i), lambda start: F.struct(
            start.alias("start"), (start + size(m)).alias("end"), m.alias("value"), left(i).alias("left"), right(i).alias("right"))))))

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, no_spans()).otherwise(
        let(F.split(text, pattern, -1), lambda between: spans(found, between))))
    if keep is not None:
        out = F.filter(out, lambda s: keep(s["value"]))
    return F.when(when, out).otherwise(no_spans()) if when is not None else out


def joined_spans(spans: Column) -> Column:
    """Structs (start, rank, end, kind) as kind:start:end, by start and then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
