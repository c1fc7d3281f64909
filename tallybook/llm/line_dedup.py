"""Lines that repeat with a few typing differences, with DataFrame functions alone.

Two lines within ``EDITS`` edits of each other, cut into ``EDITS + 1`` segments, share at least one
segment whole. So every line is listed under its segments, and probes the segments of lines that are
up to ``EDITS`` shorter by those of its substrings that could be in the right place. Segments have one
size and place for a range of lengths, so that one probe finds lines of several lengths. Lines that
meet are verified by a banded bit-parallel edit distance: one band of ``2 * EDITS + 1`` bits of the
distance matrix moves along the diagonal, a column at a time.

Before that, two cheap bounds drop most pairs: parities of letters and of letter pairs, hashed to
60 bits, of which an edit can change a few only.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.components import connected_components
from tallybook.llm.keys import maybe_among
from tallybook.llm.storage import stored

EDITS = 2
LEAST_CHARS = 24


def near_duplicate_lines(
    docs: DataFrame, edits: int = EDITS, least_chars: int | None = None
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: texts without the lines that repeat an earlier one.

    Lines are what line feeds separate, without blanks, tabs and carriage returns at their ends.
    Lines of at least ``least_chars`` code points within ``edits`` edits (insert, delete, replace
    a code point) of each other are linked; of all lines that links connect, equal ones included,
    only the first stays, by document id and place. Shorter lines all stay.

    Without ``least_chars`` every line that is not blank counts: those of ``LEAST_CHARS`` are
    linked within ``edits`` edits, shorter ones within as many less as they are shorter (12 code
    points for each of two edits, by the shorter line of a pair), and the shortest if equal.

    A null text stays null with no lines, an empty one has one (empty) line. Null ids come last;
    rows that repeat an id and a line keep it in each. An empty table gives no rows, and other
    columns are not read.
    """
    by_length = [(edits, least_chars or LEAST_CHARS, None)]
    if least_chars is None:
        each = LEAST_CHARS // max(edits, 1)
        # A line that is just too short for one edit more meets lines longer by its edits.
        by_length = [(e, max(each * e, 2 * e + 2), each * (e + 1) - 1 + e) for e in range(1, edits)]
        by_length.append((edits, LEAST_CHARS, None))
    if any(least <= 2 * e + 1 for e, least, _ in by_length):
        raise ValueError("lines must be longer than the band of the edit distance")
    least_chars = least_chars or 1
    docs = docs.select("doc_id", "text")
    # Every different line once, told apart by its text; all that follows starts from this table.
    lines = stored(
        _long_lines(docs, least_chars)
        .groupBy("line")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("first")
        )
        .withColumn("line_id", F.monotonically_increasing_id()),
        "lines",
    )
    links = _links(lines, *by_length[0])
    for edits_and_lengths in by_length[1:]:
        links = links.unionByName(_links(lines, *edits_and_lengths))
    roots = connected_components(links).withColumnRenamed("node", "line_id")
    # Most lines are in no link: they are a class each and are not shuffled.
    places = lines.select("line_id", "first")
    linked = maybe_among(places, roots, ["line_id"], True).join(roots, "line_id", "left")
    firsts = (
        linked.groupBy(F.coalesce("root", "line_id").alias("class"))
        .agg(F.min("first").alias("first"))
        .select("first")
        .unionByName(maybe_among(places, roots, ["line_id"], False).select("first"))
    )
    kept = stored(
        firsts.groupBy("first.doc_id").agg(F.collect_set("first.at").alias("kept")), "kept-lines"
    )
    # Documents that keep all their lines are not shuffled with their texts.
    whole = stored(
        docs.select("doc_id", _n_long(F.col("text"), least_chars).alias("_long"))
        .join(_as_key(kept), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        .where("_long > coalesce(size(kept), 0)")
        .select("doc_id")
        .distinct(),
        "cut-docs",
    )
    near = maybe_among(docs, whole, ["doc_id"], True)
    others = maybe_among(docs, whole, ["doc_id"], False)
    cut = near.join(_as_key(kept), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    split = F.split("text", "\n")
    stays = F.filter(
        "said",
        lambda x, at: F.array_contains(F.coalesce("kept", F.array().cast("array<int>")), at)
        | (F.length(_trimmed(x)) < least_chars),
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines")
    n_dropped = F.when(F.col("said").isNull(), 0).otherwise(F.size("said") - F.size("stays"))
    return (
        cut.select("doc_id", "kept", split.alias("said"))
        .select("doc_id", "said", stays.alias("stays"))
        .select(
            "doc_id",
            F.array_join("stays", "\n").alias("text"),
            F.when(F.col("said").isNull(), 0).otherwise(F.size("said")).alias("n_lines"),
            n_dropped.alias("n_dropped"),
        )
        .unionByName(others.select("doc_id", "text", n_lines, F.lit(0).alias("n_dropped")))
    )


def _as_key(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("doc_id").alias("_id"), "kept")


def _trimmed(line: Column) -> Column:
    line = F.ltrim(line, F.lit(" \t\r"))
    # Trimming at the end walks through the whole line: only where there is something to trim.
    blank = F.endswith(line, F.lit(" ")) | F.endswith(line, F.lit("\t")) | F.endswith(line, F.lit("\r"))
    return F.when(blank, F.rtrim(line, F.lit(" \t\r"))).otherwise(line)


def _n_long(text: Column, least_chars: int) -> Column:
    """How many lines of a text count: those that ``_long_lines`` gives."""
    visible, any_char = "[^ \\t\\r\\n]", "[^\\n]"
    longer = f"{any_char}{{{least_chars - 2},}}{visible}" if least_chars > 1 else ""
    found = F.regexp_count(text, F.lit(f"{visible}{longer}{any_char}*"))
    return F.when(text.isNull(), 0).otherwise(found)


def _long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """Every line that counts, with its place."""
    said = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return said.select("doc_id", "at", _trimmed(F.col("line")).alias("line")).where(
        F.length("line") >= least_chars
    )


# --- candidates ------------------------------------------------------------------------------


def _keys(lines: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """Hashes ``key`` under which each line is listed (``listed``) or probes.

    Lengths are dealt to ranges of ``4 * edits``; the shortest line of a range is cut into segments of
    one size, and all lines of the range have those of the first half at the same places from their
    start, the others from their end. Between two lines within ``edits`` edits one segment is whole
    that has as many edits before it as segments, and the rest at most after it; that bounds how far
    a probe is from the segment's place. A line probes its own range, and the one below where that
    has lines that are at most ``edits`` shorter.
    """
    parts, width = edits + 1, max(4 * edits, 1)
    places = [
        (i, shift)
        for i in range(parts)
        for shift in range(-min(i, edits - i), min(i, edits - i) + 1)
    ]
    # The places under which a line is listed come first.
    places.sort(key=lambda place: place[1] != 0)

    def key(i: int, shift: int, base: str) -> str:
        size = f"int(({base}) div {parts})"
        if 2 * i <= edits:
            start = f"1 + {size} * {i} + {shift}"
        else:
            start = f"length - {size} * {parts - i} + 1 + {shift}"
        return f"xxhash64({base}, {i}, substring(line, {start}, {size}))"

    def below(i: int, shift: int) -> str:
        # By how much a line can be shorter with so many edits on either side.
        most = min(edits, shift + edits - i if 2 * i <= edits else i - shift)
        return f"if(base > {least_chars} AND length - base < {most}, {key(i, shift, f'base - {width}')}, null)"

    keys = [key(*place, "base") for place in places] + [below(*place) for place in places]
    return (
        lines.select("line_id", "line", F.length("line").alias("length"))
        .withColumn("base", F.expr(f"length - (length - {least_chars}) % {width}"))
        .select("line_id", F.posexplode(F.array(*[F.expr(k) for k in keys])).alias("place", "key"))
        .where("key IS NOT NULL")
        .select("line_id", "key", (F.col("place") < parts).alias("listed"))
    )


def _links(lines: DataFrame, edits: int, least_chars: int, most_chars: int | None) -> DataFrame:
    """Pairs of different lines within so many edits."""
    lines = lines.select("line_id", "line").where(F.length("line") >= least_chars)
    if most_chars is not None:
        lines = lines.where(F.length("line") <= most_chars)
    keys = _keys(lines, edits, least_chars)
    meeting = (
        keys.groupBy("key")
        .agg(
            F.min("line_id").alias("low"),
            F.max("line_id").alias("high"),
            F.max(F.col("listed").cast("int")).alias("has_listed"),
        )
        .where("low < high AND has_listed = 1")
        .select("key")
    )
    meeting = stored(meeting, "meeting-keys")
    # Most keys are of one line: they stay where they are.
    met = maybe_among(keys, meeting, ["key"], True).join(meeting, "key").distinct()
    met = stored(met, "met-lines")
    texts = stored(maybe_among(lines, met, ["line_id"], True), "met-texts")
    sketches = stored(_sketches(texts), "line-sketches")
    places = met.join(sketches, "line_id")
    # The range of lengths of a key is wider than what edits explain: lengths are part of the join.
    a = places.where("listed").alias("a")
    shorter = F.explode(F.sequence(F.col("length") - edits, F.col("length")))
    b = places.withColumn("other", shorter).alias("b")
    # The bounds are part of the join: pairs that fail them are not made.
    near = a.join(
        b,
        F.expr(f"""a.key = b.key AND a.length = b.other AND a.line_id <> b.line_id
            AND bit_count(a.ones ^ b.ones) <= {2 * edits}
            AND bit_count(a.twos ^ b.twos) <= {4 * edits}"""),
    ).select(
        F.least("a.line_id", "b.line_id").alias("a"), F.greatest("a.line_id", "b.line_id").alias("b")
    )
    near = stored(near.distinct(), "near-lines")
    one, two = (texts.selectExpr(f"line_id AS {x}", f"line AS {x}_line") for x in ("a", "b"))
    within = banded_distance(F.col("a_line"), F.col("b_line"), edits) <= edits
    return near.join(one, "a").join(two, "b").where(within).select("a", "b")


def _chars(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def _sketches(texts: DataFrame) -> DataFrame:
    """``line_id, length, ones, twos``: parities of the characters, and of neighbouring two.

    60 bits each: for each hash, whether it occurs an odd number of times. An edit changes 2 bits at
    most of the first and 4 of the second.
    """
    one = F.lit(1).cast("bigint")

    def bit(*gram: Column) -> Column:
        place = F.pmod(F.xxhash64(*gram), F.lit(60)).cast("int")
        return F.call_function("shiftleft", one, place)

    chars = texts.select("line_id", F.split("line", "").alias("chars"))
    following = F.get("chars", F.col("i") + 1)
    return (
        chars.select("line_id", "chars", F.posexplode("chars").alias("i", "char"))
        .groupBy("line_id")
        .agg(
            F.count("*").cast("int").alias("length"),
            F.bit_xor(bit(F.col("char"))).alias("ones"),
            F.bit_xor(F.when(following.isNotNull(), bit(F.col("char"), following)).otherwise(F.lit(0))).alias("twos"),
        )
    )


# --- edit distance ---------------------------------------------------------------------------


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two texts where it is at most ``edits``, else any greater number.

    Bit ``k`` of the band stands, in column ``j``, for row ``j - edits + k``. ``vp`` and ``vn`` say
    where the distance grows or falls by one from the row above. The score follows the lower edge
    of the band down to the last row of ``a``, and then that row.
    """
    letters = F.struct(_chars(a).alias("a"), _chars(b).alias("b"))
    return _let(letters, lambda both: _banded(both["a"], both["b"], edits))


def _banded(a_chars: Column, b_chars: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full = (1 << width) - 1
    mask, none = _big(full), _big(0)
    rows = F.size(a_chars)

    def matches(letter: Column, j: Column) -> Column:
        found = none
        for k in range(width):
            same = F.coalesce(F.get(a_chars, j - edits + k) == letter, F.lit(False))
            found = found.bitwiseOR(F.when(same, _big(1 << k)).otherwise(none))
        return found

    # From here on per column: its number from 1, and where its letter stands in the band.
    columns = F.transform(
        b_chars, lambda letter, j: F.struct((j + 1).alias("j"), matches(letter, j).alias("pm"))
    )
    start = F.struct(
        _big(full & ~((1 << edits) - 1)).alias("vp"), none.alias("vn"), F.lit(edits).alias("score")
    )

    def step(state: Column, column: Column) -> Column:
        vp, vn, pm = state["vp"], state["vn"], column["pm"]
        diagonal = (
            (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(mask)
        )

        def rest(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            # Row of the lower edge, or the last row once the edge has passed it.
            place = F.least(F.lit(2 * edits), rows - column["j"] + edits)
            along = _bit(hp, place) - _bit(hn, place)
            grown = F.when(column["j"] + edits <= rows, 1 - _bit(d0, place)).otherwise(along)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                hp.bitwiseAND(down).alias("vn"),
                (state["score"] + grown).cast("int").alias("score"),
            )

        return _let(diagonal, rest)

    return F.aggregate(columns, start, step, lambda state: state["score"])


def _bit(bits: Column, place: Column) -> Column:
    return F.getbit(bits, F.greatest(place, F.lit(0))).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")
