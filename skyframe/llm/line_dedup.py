"""Line dedup by winnowing: later copies of repeated runs of lines are deleted, the first one stays.

Texts are cut after line ends, after marks that end a sentence or a part of one, and after words that end in ``d`` or ``y``,
so that a passage that begins or ends inside a line, or has a word changed in one, is found but for a few words; such a piece
is called a line here. A line is deleted if it lies in a run of lines of at least ``MIN_WORDS`` words in all that is also found
before: in an earlier document (by document id, then hash of the text) or earlier in the same one, where runs may overlap.

From each line on there is one shortest run of ``MIN_WORDS`` words, and one or more that end before the next line's does: these are
the windows. The hash of a window's longest line (in words, up to 25; the least hash of several) is its fingerprint; neighbouring windows mostly share it, and every copy of
a run selects the same ones; long lines are seldom equal by chance. Fingerprints are joined by hash over all documents, and those found once go, with their
windows. A match is then extended to both sides of its fingerprint by the windows around it, compared by the hash of all
their lines: each but the first of its hash is deleted, and together these cover the run from end to end.
Each window meets one row, its first occurrence, however many documents hold it.

Defined results: a null text stays null and has no lines; null ids come before all others; rows with the same id and
text count as one document and get the same result; blank lines are passed over in runs and go with the line before
them; a text without places to cut is one line; work and memory follow the length of a text, however long; an empty table
gives an empty table; extra columns of any name pass through, but for n_lines, n_deleted and words_deleted, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, discard, documents, let, stage_table

MIN_WORDS = 25
#: Pieces keep the characters that end them, so that the kept ones make up the text.
CUT = r"(?<=\n)|(?<=[.!?,;:dy] )"
#: The same places, with the white space before them: what is left are the pieces without it.
BREAK = r"[ \n](?:(?<=[.!?,;:dy] )|(?<=\n))"
UNEVEN = r"[\x09-\x0D]|\x20\x20"
#: Of a line's long, the lower bits are its hash, those above tell how many words it lacks to MIN_WORDS: the least is a longest line.
HASH_BITS = 58


def _lines(text: Column, cut: str) -> Column:
    return F.when(text.isNotNull() & (text != ""), F.split(text, cut)).otherwise(F.array().cast("array<string>"))


def _even(text: Column) -> Column:
    """Whether pieces cut at BREAK have single spaces between words and no other white space."""
    odd = text.startswith(" ") | text.endswith(" ")
    for x in ("  ", "\n ", " \n", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | text.contains(x)
    return ~odd


def _hashed(docs: DataFrame, text: str, cut: str) -> DataFrame:
    """(doc_id, th, n_lines, at, h): a text's lines that aren't blank, as longs; th is its hash, at their places (null: all)."""
    bare = F.transform(_lines(F.col(text), cut), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    words = F.transform(bare, lambda x: F.when(x.rlike(UNEVEN), F.regexp_replace(x, GAP, " ")).otherwise(x))
    if cut == CUT:  # most texts need no line looked at for its white space
        words = F.when(_even(F.col(text)), _lines(F.col(text), BREAK)).otherwise(words)
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), words.alias("words"))
    at = F.filter(F.transform("words", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    lacks = lambda x: F.greatest(F.lit(0), MIN_WORDS - 1 - (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))))
    h = F.transform(F.array_remove("words", ""), lambda x: F.shiftleft(lacks(x).cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x), 64 - HASH_BITS)))
    n_lines = F.size("words").cast("long").alias("n_lines")
    return rows.select("doc_id", "th", n_lines, F.when(F.array_contains("words", ""), at).alias("at"), h.alias("h"))


def _windows(hashed: DataFrame) -> DataFrame:
    """(doc_id, th, n_lines, at, kn, f, g): the shortest runs of enough words that start, or end, with each line, side by side.

    ``kn`` is 32 times a window's first line plus its number of lines, which is at most MIN_WORDS; ``f`` its fingerprint, the
    least of its lines' longs; ``g`` the hash of the whole window.
    """
    # words of a line beyond MIN_WORDS change no window
    count = lambda x: (MIN_WORDS - F.shiftright(x, HASH_BITS)).cast("int")
    starts = F.array(*(F.array(*(F.lit(j == 0) for j in range(n))) if n else F.array().cast("array<boolean>") for n in range(MIN_WORDS + 1)))
    # the line of each word, and whether it is the line's first
    owner = F.flatten(F.transform("h", lambda x, k: F.array_repeat(k, count(x))))
    begins = F.flatten(F.transform("h", lambda x: F.get(starts, count(x))))
    rows = hashed.select("*", owner.alias("owner"), begins.alias("begins"))
    # a window from a line on ends with the line of its last word
    ahead = F.slice("owner", MIN_WORDS, F.greatest(F.lit(0), F.size("owner") - MIN_WORDS + 1))
    rows = rows.select("doc_id", "th", "n_lines", "at", "h", F.filter(ahead, lambda e, j: F.get("begins", j)).alias("ends"))
    # between the ends of this line's window and the next line's, windows that end with a line start here
    last = lambda e, k: F.greatest(e, F.coalesce(F.get("ends", k + 1), F.size("h")) - 1)
    kn = F.flatten(F.transform("ends", lambda e, k: F.sequence(31 * k + e + 1, 31 * k + last(e, k) + 1)))
    rows = rows.select("doc_id", "th", "n_lines", "at", "h", kn.alias("kn"))
    runs = F.transform("kn", lambda x: F.slice("h", F.shiftright(x, 5) + 1, x.bitwiseAND(31)))
    rows = rows.select("doc_id", "th", "n_lines", "at", "kn", runs.alias("runs"))
    f, g = F.transform("runs", F.array_min), F.transform("runs", lambda s: F.xxhash64(s))
    return rows.select("doc_id", "th", "n_lines", "at", "kn", f.alias("f"), g.alias("g"))


def _winnowed(windows: DataFrame) -> DataFrame:
    """(doc_id, th, n_lines, at, f, kn, g, twice): a row for each fingerprint in order, each once, with the windows it is the least of.

    A document's first row, which has no fingerprint where it has no window, tells n_lines and at; others have n_lines null.
    """
    places = F.when(F.size("f") > 1, F.sequence(F.lit(1), F.size("f") - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.concat(F.array(F.lit(0)), F.filter(places, lambda i: F.get("f", i - 1) != F.get("f", i)))
    rows = windows.select("doc_id", "th", "n_lines", "at", "kn", "f", "g", heads.alias("heads"))

    def print_(i: Column, j: Column) -> Column:
        # arrays side by side take less than half of what an array of structs takes in a shuffle
        n = F.coalesce(F.get("heads", j + 1), F.size("f")) - i
        first = [F.when(i == 0, F.col(c)).alias(c) for c in ("n_lines", "at")]
        return F.struct(*first, F.get("f", i).alias("f"), *(F.slice(c, i + 1, n).alias(c) for c in ("kn", "g")))

    rows = rows.select("doc_id", "th", F.explode(F.transform("heads", print_)).alias("x")).select("doc_id", "th", "x.*")
    # equal lines in a row make one fingerprint, which counts twice if its own windows repeat
    return rows.withColumn("twice", F.size(F.array_distinct("g")) < F.size("g"))


def repeated(docs: DataFrame, text: str = "text", cut: str = CUT) -> DataFrame:
    """(doc_id, th, n_lines, cut), stored: the lines of each distinct document, and those to delete (null for none)."""
    texts = stage_table(_winnowed(_windows(_hashed(docs, text, cut))), "prints")
    sizes = stage_table(texts.filter("n_lines IS NOT NULL").select("doc_id", "th", "n_lines", "at").dropDuplicates(["doc_id", "th"]), "sizes")
    own = texts.filter("f IS NOT NULL")
    # what is joined with is written first: between two plain tables Spark can split the rows of a very common fingerprint
    often = stage_table(own.groupBy("f").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("times")).filter("times > 1").select("f"), "often")
    met = own.join(often, "f", "left_semi").select("doc_id", "th", F.explode(F.arrays_zip("kn", "g")).alias("x"))
    shared = stage_table(met.select("doc_id", "th", "x.kn", "x.g"), "shared")
    discard(texts, often)
    firsts = shared.groupBy("g").agg(F.min(F.struct("doc_id", "th", "kn")).alias("f"), F.count("*").alias("times"))
    first = stage_table(firsts.filter("times > 1").select("g", "f"), "first")
    later = shared.join(first, "g").filter("NOT (doc_id <=> f.doc_id AND th = f.th AND kn = f.kn)")
    runs = later.groupBy("doc_id", "th").agg(F.collect_set("kn").alias("runs"))
    ks = F.flatten(F.transform("runs", lambda x: F.sequence(F.shiftright(x, 5), F.shiftright(x, 5) + x.bitwiseAND(31) - 1)))
    runs = runs.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), F.sort_array(F.array_distinct(ks)).alias("ks"))
    both = sizes.join(runs, sizes["doc_id"].eqNullSafe(runs["c_id"]) & (sizes["th"] == runs["c_th"]), "left")
    # a line goes with the blank ones behind it
    end = lambda k: F.coalesce(F.get("at", k + 1), F.col("n_lines").cast("int")) - 1
    gone = F.when(F.col("at").isNull(), F.col("ks")).otherwise(F.flatten(F.transform("ks", lambda k: F.sequence(F.get("at", k), end(k)))))
    cuts = stage_table(both.select("doc_id", "th", "n_lines", gone.alias("cut")), "cuts")
    discard(sizes, shared, first)
    return cuts


def dedup_lines(docs: DataFrame, text: str = "text", cut: str = CUT) -> DataFrame:
    """The documents with later repeated runs deleted from their text; adds n_lines, n_deleted and words_deleted (long).

    ``cut`` is a pattern without width that matches where lines end.
    """
    docs = docs.drop("n_lines", "n_deleted", "words_deleted")
    cuts = repeated(docs, text, cut)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("row_th"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("row_th") == F.col("th"))
    joined = keyed.join(cuts, same).select("row", "n_lines", "cut")
    whole, gone_at = F.col("row")[text], F.col("cut")

    def made(lines: Column) -> Column:
        gone = F.array_join(F.transform(F.sort_array(gone_at), lambda k: F.get(lines, k)), "")
        left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_at), lambda k: F.get(lines, k))
        return F.struct(F.array_join(left, "").alias("left"), F.size(F.filter(F.split(gone, GAP), lambda x: x != "")).alias("words"))

    # the lines are bound once: plans that read one column only must not cut the text again for each of them
    staged = joined.withColumn("made", F.when(gone_at.isNotNull(), let(_lines(whole, cut), made)))
    return staged.select(
        *(F.coalesce("made.left", whole).alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns),
        "n_lines",
        F.when(gone_at.isNull(), 0).otherwise(F.size(gone_at)).cast("long").alias("n_deleted"),
        F.coalesce("made.words", F.lit(0)).cast("long").alias("words_deleted"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated runs; documents of which nothing is left go."""
    others = F.struct(F.lit(0).alias("__one"), *(c for c in docs.columns if c not in ("doc_id", "text")))
    rows = dedup_lines(docs.select("doc_id", "text", others.alias("__row")))
    # an emptied text explodes into no row; a filter would move below the cutting and have it done again
    stays = F.when(F.expr("n_deleted = 0 OR text RLIKE '[^ \\\\t-\\\\r]'"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    rest = rows.select("*", F.explode(stays))
    return rest.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__row")[c].alias(c) for c in docs.columns))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE: dict[str, str] = {}
