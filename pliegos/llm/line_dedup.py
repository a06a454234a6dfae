"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared trimmed and in lower case. The unit of an edit is a word in lines of ``LEAST_WORDS``
words or more, and a character in shorter lines. Two lines match when they are equal, or when both have
the same unit and one edit (another unit, one more, one fewer) turns one into the other; lines of fewer than
``LEAST_CHARACTERS`` characters match only when equal, as one edit makes another word of them. A line goes when an
earlier line matches it; earlier is by document id, then by place. Lines without text always stay.

Equal lines meet first, by a 128-bit hash, with the earliest kept. Then lines emit their deletion neighbourhood
as hashed keys: themselves, and themselves without each of their units. Lines whose variants lack the
unit at the same place match each other, so each is paired with the earliest of its key only; a line that equals a variant
of another is paired with it. That is a pair for each key at most, however many lines share it. Pairs
are verified by their edit distance.

Two filters keep variants few, and lose no match. One edit leaves the first or the last half of a line as it
is: a line emits variants only if it shares a half with another line, and only without units outside that half. And a
variant is first hashed by its pairs of neighbouring units, which takes the same few steps however long the
line is; only variants whose sum occurs in another line are spelled out.

Defined results: a null text stays null and counts no lines; empty texts have one empty line;
rows with one id and one text are one document; rows with one id and other texts are ordered by
the hash of their text; null ids come first; very long texts and lines are compared whole; columns of ``docs`` besides
the id and the text are carried as they are, and n_lines and n_kept get underscores where those names are
taken; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import free_name, staged

LEAST_WORDS, LEAST_CHARACTERS = 5, 10
PLACE = ["doc", "version", "pos"]


def _normal(line: Column) -> Column:
    return F.trim(F.lower(line))


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, version, pos, norm of each line with text."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"), _hash(F.col(text_col)).alias("version"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")
    )
    return rows.select(*PLACE, _normal(F.col("line")).alias("norm")).where("norm <> ''")


def _word_count(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _half(side: int, size: str) -> Column:
    """The key of the first (side 0) or last ``size`` units; null for lines that match only when equal."""
    words = F.expr(f"substring_index(norm, ' ', {'-' if side else ''}{size})")
    characters = F.expr(f"{'right' if side else 'left'}(norm, {size})")
    return F.when(F.col("by_words"), _hash(F.lit(side), F.col(size), words)).when(F.col("units") >= LEAST_CHARACTERS, _hash(F.lit(side + 2), F.col(size), characters))


def _distinct_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, first (its earliest place), units and the keys of its halves.

    Lines of n and n + 1 units share halves of n / 2 units, rounded down; lines of n units those of (n - 1) / 2.
    """
    rows = lines.select(F.struct(*PLACE).alias("place"), "norm", _word_count(F.col("norm")).alias("words"))
    rows = rows.withColumn("by_words", F.col("words") >= LEAST_WORDS).withColumn("units", F.when(F.col("by_words"), F.col("words")).otherwise(F.length("norm")))
    rows = rows.withColumns({"half": F.expr("int(floor((units - 1) / 2))"), "next_half": F.expr("int(floor(units / 2))")})
    longer = F.col("next_half") > F.col("half")
    keyed = rows.select(
        "place", "units", _hash(F.col("norm")).alias("h1"), _hash(F.lit(1), F.col("norm")).alias("h2"),
        *[_half(side, "half").alias(f"k{side}") for side in (0, 1)], *[F.when(longer, _half(side, "next_half")).alias(f"n{side}") for side in (0, 1)],
    )
    return keyed.groupBy("h1", "h2").agg(F.min("place").alias("first"), *[F.first(k).alias(k) for k in ("units", "k0", "k1", "n0", "n1")])


def _with_partners(distinct: DataFrame) -> DataFrame:
    """first, low, high of the distinct lines that share a half with another one: the units from low to high may differ."""
    half, next_half = F.expr("int(floor((units - 1) / 2))"), F.expr("int(floor(units / 2))")
    halves = F.array(*[F.struct(F.col(f"{kind}{side}").alias("key"), (size + 1 if side == 0 else F.lit(1)).alias("low"), (F.col("units") if side == 0 else F.col("units") - size).alias("high"))
                       for kind, size in (("k", half), ("n", next_half)) for side in (0, 1)])
    keys = distinct.select("h1", "h2", F.explode(halves).alias("k")).select("h1", "h2", "k.*").where(F.col("key").isNotNull())
    shared = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    met = keys.join(staged(shared, "shared-halves"), "key", "left_semi").groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return met.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]).select("first.*", "low", "high")


def _texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """place, units (the words or characters of the line), low and high of the lines at ``places``."""
    wanted = places.groupBy("doc", "version").agg(F.collect_list(F.struct("pos", "low", "high")).alias("wanted"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _hash(F.col(text_col)).alias("v"), F.col(text_col).alias("t"))
    met = rows.join(wanted, F.col("id").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version"))).select("doc", "version", F.split("t", "\n").alias("all"), "wanted")
    # each wanted place with its own line: the others do not travel
    own = met.select("doc", "version", F.explode(F.expr("transform(wanted, w -> struct(w.pos as pos, w.low as low, w.high as high, all[w.pos] as line))")).alias("w"))
    lines = own.select(F.struct("doc", "version", "w.pos").alias("place"), _normal(F.col("w.line")).alias("norm"), "w.low", "w.high")
    units = F.when(_word_count(F.col("norm")) >= LEAST_WORDS, F.split("norm", " ")).otherwise(F.split("norm", ""))
    return lines.select("place", (_word_count(F.col("norm")) >= LEAST_WORDS).alias("by_words"), units.alias("units"), "low", "high").dropDuplicates(["place"])


#: Sums of 40-bit hashes of neighbouring units, so that no sum of a line overflows; the ends count as empty units.
_PAIR = "shiftrightunsigned(xxhash64({a}, {b}), 24)"
_SUMMED = f"""
    transform(array(transform(sequence(0, size(units)), i -> {_PAIR.format(a="if(i = 0, '', units[i - 1])", b="if(i = size(units), '', units[i])")})), p ->
        struct(p, aggregate(p, 0L, (a, x) -> a + x) as total))[0]
"""
_SUM_WITHOUT = f"""
    transform(filter(sequence(0, high), g -> g = 0 or g >= low), g -> struct(g as gone,
        case when g = 0 then s.total else s.total - s.p[g - 1] - s.p[g] + {_PAIR.format(a="if(g = 1, '', units[g - 2])", b="if(g = size(units), '', units[g])")} end as total))
"""
_WITHOUT = """
    transform(gones, g -> struct(g as gone, case when g = 0 then xxhash64(concat_ws('\n', units)) else xxhash64(concat_ws('\n', slice(units, 1, g - 1), slice(units, g + 1, size(units)))) end as v))
"""


def _neighbourhood(texts: DataFrame) -> DataFrame:
    """v (hash of the variant), by_words, left (its units), gone (the place of the unit left out, 0 for none), place: of variants that may occur in another line."""
    sums = texts.withColumn("s", F.expr(_SUMMED)).select("place", "by_words", F.size("units").alias("n"), F.explode(F.expr(_SUM_WITHOUT)).alias("x"))
    sums = sums.select("place", F.col("x.gone").alias("gone"), _hash(F.col("by_words"), F.col("n") - (F.col("x.gone") > 0).cast("int"), F.col("x.total")).alias("sum"), _hash("place").alias("line"))
    sums = staged(sums, "variant-sums")
    twice = sums.groupBy("sum").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("sum")
    gones = sums.join(twice, "sum", "left_semi").groupBy("place").agg(F.collect_set("gone").alias("gones"))
    met = texts.join(gones, "place").select("place", "by_words", F.size("units").alias("n"), F.explode(F.expr(_WITHOUT)).alias("x"))
    return met.select("x.v", "by_words", (F.col("n") - (F.col("x.gone") > 0).cast("int")).alias("left"), "x.gone", "place")


def _pairs(variants: DataFrame) -> DataFrame:
    """Pairs (early, late) of places to verify: at most one or two for each variant."""
    key = ["v", "by_words", "left"]
    gone = variants.where("gone > 0")
    earliest = gone.groupBy(*key, "gone").agg(F.min("place").alias("early"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    replaced = gone.join(earliest, [*key, "gone"]).where("early < place").select("early", F.col("place").alias("late"))
    whole = variants.where("gone = 0").select(*key, F.col("place").alias("whole"))
    added = gone.join(whole, key).select(F.least("whole", "place").alias("early"), F.greatest("whole", "place").alias("late"))
    return replaced.union(added).distinct()


#: Whether the lists a and b are within one edit: what follows the first difference must agree.
WITHIN_ONE_EDIT = """
    case when size(a) = size(b) then slice(a, same + 2, size(a)) = slice(b, same + 2, size(b))
         when size(a) = size(b) + 1 then slice(a, same + 2, size(a)) = slice(b, same + 1, size(b))
         when size(b) = size(a) + 1 then slice(b, same + 2, size(b)) = slice(a, same + 1, size(a))
         else false end
"""


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The places that have an earlier line within one edit."""
    a = texts.select(F.col("place").alias("early"), F.col("units").alias("a"))
    b = texts.select(F.col("place").alias("late"), F.col("units").alias("b"))
    first_other = F.expr("array_position(transform(sequence(1, least(size(a), size(b))), i -> a[i - 1] <> b[i - 1]), true)")
    same = F.when(first_other == 0, F.expr("least(size(a), size(b))")).otherwise(first_other - 1).cast("int")
    return pairs.join(b, "late").join(a, "early").withColumn("same", same).where(F.expr(WITHIN_ONE_EDIT)).select("late").distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, version (hash of the text) and kept: the places of the lines with text that stay."""
    distinct = staged(_distinct_lines(_lines(docs, id_col, text_col)), "distinct-lines")
    texts = staged(_texts(docs, _with_partners(distinct), id_col, text_col), "line-texts")
    pairs = staged(_pairs(staged(_neighbourhood(texts), "variants")), "line-pairs")
    near = staged(_verified(pairs, texts), "near-lines")
    stay = distinct.join(near, F.col("first") == F.col("late"), "left_anti")
    return stay.select("first.*").groupBy("doc", "version").agg(F.collect_list("pos").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as their texts, and the columns n_lines and n_kept."""
    n_lines, n_kept, version, kept = (free_name(docs, c) for c in ("n_lines", "n_kept", "line_version", "line_kept"))
    found = kept_lines(docs, id_col, text_col).select(F.col("doc").alias(free_name(docs, "line_doc")), F.col("version").alias(free_name(docs, "line_text")), F.col("kept").alias(kept))
    doc, text = found.columns[:2]
    lines = F.split(F.col(text_col), "\n")
    # places without text, and places that stay, in order: a walk of the lines and one of the places
    blank = F.filter(F.transform(lines, lambda line, i: F.when(_normal(line) == "", i)), lambda i: i.isNotNull())
    places = F.array_sort(F.concat(blank, F.coalesce(F.col(kept), F.array().cast("array<int>"))))
    stays = F.transform(F.array(F.struct(lines.alias("all"), places.alias("places"))), lambda x: F.transform(x["places"], lambda i: x["all"][i]))[0]
    return (
        docs.withColumn(version, _hash(F.col(text_col)))
        .join(found, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(version) == F.col(text)), "left")
        .withColumn(n_lines, F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
        .withColumn(kept, F.when(F.col(text_col).isNotNull(), stays))
        .withColumn(n_kept, F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(kept)), F.lit(0)).cast("long"))
        .withColumn(text_col, F.array_join(kept, "\n"))
        .select(*docs.columns, n_lines, n_kept)
    )
