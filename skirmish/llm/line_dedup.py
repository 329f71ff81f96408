"""Line deduplication up to a few edits by partitioning lines into segments.

Lines are the parts of a text between line feeds; empty ones do not count. Equal
lines are one line, named by a 64-bit hash. Two different lines of ``SHORTEST``
code points or more are linked if their edit distance is at most ``EDITS``;
shorter ones only equal themselves. Classes are the connected components.

If two lines are within k edits, one of k + 1 even segments of the shorter one
stands unchanged in the longer one, near its own place. So a line is posted
under each of its segments (with its length and the segment's number), and asks
for the substrings of its own text where a segment of a line of its length, or
up to k less, may stand: for k = 2 three postings and twelve questions a line.
Of the start positions only those count that leave enough edits on both sides
of the segment (counted from the left for those before it, from the right for
those after it); this loses no pair.

Different lines are written once, so copies cost nothing. Keys are all that is
shuffled; lines that ask for a crowded key come out of the join as such, and
only for them keys are worked out once more, with the text.
Segments that many lines share are split further: the text around the segment
must itself be within k edits, so lines are dealt once more by the k + 1
segments of the rest (see ``_split``). Lines that differ in a word or two share
such keys however often the rest is cut. So keys that are crowded even then
are dealt by the letters of the rest: of a line within k edits all letters but
k at most, counted with repeats, stand in the other one too, so both agree on
a sum over their letters less those that the other one lacks. Two lines meet
only where what they leave out has no letter in common, that is under this one
sum. Letters are folded into ``CLASSES`` classes, so a line
asks for at most C(CLASSES + k, k) sums, whatever its length and whoever
shares its key. Both steps are exact. Lines under split keys meet only where few
letters and few pairs of letters stand an odd number of times in just one of
them: an edit changes two letters and four pairs at most. Candidate pairs whose starts or ends are
more than 2 k edits apart are dropped, the others verified by the banded
bit-parallel edit distance. Keys have 48 bits; two that agree by chance cost a
comparison.

Everything here is built-in functions: no Python runs on the rows. Null texts
have no lines. Rows of one doc_id that repeat hold their lines twice. The first
occurrence of a line is that with the least (doc_id, line_no), null doc_id
first. Extra columns are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import components, released
from skirmish.session import cut

EDITS, SHORTEST = 2, 20
# Lines posted under one key beyond which the rest of the line is split too, by segments and by letters
# (a line has some hundreds of letter sums, so these pay where it would meet more lines than that).
CROWD, CROWD_LETTERS = 6, 512
# Classes that letters are folded into.
CLASSES = 32
# Candidate lines sent to every task, at most (8 bytes each).
MANY = 1 << 20
# Characters at both ends of a pair that are compared first.
ENDS = 48


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, length, id of every line with text.

    Length and id are worked out once, before the lines become rows.
    """
    parts = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(x.alias("line"), F.char_length(x).alias("length"), F.xxhash64(x).alias("id")),
    )
    exploded = docs.select("doc_id", F.posexplode(parts).alias("line_no", "l"))
    return exploded.where("l.length > 0").select("doc_id", "line_no", "l.line", "l.length", "l.id")


def _offsets(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings a line asks for."""
    out = []
    for less in range(edits + 1):
        for number in range(1, edits + 2):
            before, after = number - 1, edits + 1 - number
            for shift in range(max(-before, less - after), min(before, less + after) + 1):
                out.append((less, number, shift))
    return out


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _key(*parts: Column) -> Column:
    """48 bits of a hash: what is shuffled is mostly keys, and a chance match is verified like any other."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 16)


def _entries(
    text: Column, length: Column, edits: int, shortest: int, posted: bool, less_only: Column | None = None
) -> Column:
    """Array of (key, less, at, size): what a line is posted under, or what it asks for.

    Segments of a line of length n are even, the last ones one longer. A key is
    a hash of n, the segment's number and its text. The list of substrings is a
    constant that a higher-order function walks, which keeps the generated code
    small enough to be compiled.
    """
    parts = edits + 1
    wanted = [(0, n, 0) for n in range(1, parts + 1)] if posted else _offsets(edits)
    groups = []
    for less in range(edits + 1):
        shifts = [F.struct(F.lit(n).alias("number"), F.lit(d).alias("shift")) for g, n, d in wanted if g == less]
        if shifts:
            groups.append(F.struct(F.lit(less).alias("less"), F.array(*shifts).alias("shifts")))
    table = F.array(*groups)
    if less_only is not None:
        table = F.filter(table, lambda g: g["less"] == less_only)

    def one(g: Column) -> Column:
        other = length - g["less"]
        even = F.struct(
            other.alias("n"), F.floor(other / parts).cast("int").alias("short"), (F.lit(parts) - other % parts).cast("int").alias("shorts")
        )

        def places(v: Column) -> Column:
            def place(s: Column) -> Column:
                size = v["short"] + F.when(s["number"] > v["shorts"], 1).otherwise(0)
                start = (s["number"] - 1) * v["short"] + F.greatest(s["number"] - 1 - v["shorts"], F.lit(0)) + 1
                where = F.struct(s["number"].alias("number"), (start + s["shift"]).alias("at"), size.alias("size"))

                def keyed(w: Column) -> Column:
                    fits = (v["n"] >= shortest) & (w["at"] >= 1) & (w["at"] + w["size"] - 1 <= length)
                    key = _key(v["n"].cast("int"), w["number"], F.substring(text, w["at"], w["size"]))
                    return F.struct(
                        F.when(fits, key).alias("key"), g["less"].alias("less"), w["at"].alias("at"), w["size"].alias("size")
                    )

                return _bound(where, keyed)

            return F.transform(g["shifts"], place)

        return _bound(even, places)

    return F.filter(F.flatten(F.transform(table, one)), lambda e: e["key"].isNotNull())


def _letter_sums(text: Column, posted: bool, edits: int) -> Column:
    """(sum, out) over the letters of a text but for ``edits`` of them or fewer: what is left out is a set of bits.

    Posted are sums with every number left out, asked for those with as many as
    the line is longer (``less``) or more. Letters that are left out more often than they
    stand in the text give sums that mean nothing; they cost a comparison at worst.
    """

    def weight(c: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(c), 28)  # 36 bits: sums of 2^27 letters fit in a long

    def sums(letters: Column) -> Column:
        total = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + weight(c))
        both = F.struct(total.alias("total"), F.array_distinct(letters).alias("kinds"))

        def left_out(t: Column) -> Column:
            none = F.struct(t["total"].alias("sum"), F.lit(0).cast("long").alias("out"), F.lit(-1).alias("last"))
            steps = [F.array(none)]
            for _ in range(edits):
                steps.append(
                    F.flatten(
                        F.transform(
                            steps[-1],
                            lambda s: F.transform(
                                F.filter(t["kinds"], lambda c: c >= s["last"]),
                                lambda c: F.struct(
                                    (s["sum"] - weight(c)).alias("sum"),
                                    s["out"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)).alias("out"),
                                    c.alias("last"),
                                ),
                            ),
                        )
                    )
                )
            if posted:
                return F.concat(*steps)
            return F.concat(*[F.when(F.col("less") <= n, step).otherwise(F.slice(step, 1, 0)) for n, step in enumerate(steps)])

        return _bound(both, left_out)

    classes = F.transform(F.split(text, ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    return _bound(classes, sums)


def _split(rows: DataFrame, crowded: DataFrame, posted: bool, edits: int, letters: bool = False) -> DataFrame:
    """Entries of crowded keys dealt by the segments, or letters, of the line without theirs; others as they are.

    The next key holds the one before. ``line`` is the rest of the line, null
    where an entry was not split: those are never split later. Which keys are
    split depends on the key alone (it holds the length a segment was cut for),
    so both sides agree.
    """
    rest = F.concat(F.substring("line", F.lit(1), F.col("at") - 1), F.substring(F.col("line"), F.col("at") + F.col("size"), F.char_length("line")))
    long_enough = F.char_length("line") - F.col("size") - F.col("less") > edits
    marked = rows.join(crowded.withColumn("crowded", F.lit(True)), "key", "left").withColumn(
        "line", F.when(F.col("crowded") & long_enough, rest)
    )
    nothing = F.lit(0).cast("long").alias("out")
    same = F.struct("key", "less", "at", "size", nothing)

    def dealt(t: Column) -> Column:
        if letters:
            return F.transform(
                _letter_sums(t, posted, edits), lambda x: F.struct(_key(F.col("key"), x["sum"]).alias("key"), "less", "at", "size", x["out"].alias("out"))
            )
        found = _entries(t, F.char_length(t), edits, 1, posted, None if posted else F.col("less"))
        return F.transform(
            found,
            lambda x: F.struct(
                _key(F.col("key"), x["key"]).alias("key"), x["less"].alias("less"), x["at"].cast("long").alias("at"), x["size"].cast("long").alias("size"), nothing
            ),
        )

    entries = F.when(F.col("line").isNotNull(), _bound(F.col("line"), dealt)).otherwise(F.array(same))
    return marked.select("id", "line", F.explode(entries).alias("e")).select("id", "line", "e.*")


def _shared(a: Column, b: Column, most: Column, at_end: bool) -> Column:
    """Characters that two texts share at their start or end, ``most`` at most, by halving steps."""

    def step(p: Column, w: Column) -> Column:
        def piece(x: Column) -> Column:
            start = F.char_length(x) - p - w + 1 if at_end else p + 1
            return F.substring(x, start, w)

        return F.when(p + w <= most, F.when(piece(a) == piece(b), p + w).otherwise(p)).otherwise(p)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), F.lit(0), step)


def _trimmed(a: Column, b: Column, edits: int, use) -> Column:
    """``use`` of both texts without what they share at both ends, but for a few characters."""
    spare = edits + 1
    least = F.least(F.char_length(a), F.char_length(b))

    def after_start(p: Column) -> Column:
        def cut_start(x: Column) -> Column:
            return F.substring(x, p + 1, F.char_length(x))

        def both(t: Column) -> Column:
            most = F.least(F.char_length(t["a"]), F.char_length(t["b"]))

            def after_end(q: Column) -> Column:
                def cut_end(x: Column) -> Column:
                    return F.substring(x, F.lit(1), F.char_length(x) - q)

                return _bound(F.struct(cut_end(t["a"]).alias("a"), cut_end(t["b"]).alias("b")), lambda u: use(u["a"], u["b"]))

            return _bound(F.greatest(_shared(t["a"], t["b"], most, True) - spare, F.lit(0)), after_end)

        return _bound(F.struct(cut_start(a).alias("a"), cut_start(b).alias("b")), both)

    return _bound(F.greatest(_shared(a, b, least, False) - spare, F.lit(0)), after_start)


def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two texts longer than ``edits``; ``edits + 1`` for any larger one.

    What both share at their start and end is cut off first.
    """
    far = F.abs(F.char_length(a) - F.char_length(b)) > edits
    return F.when(far, F.lit(edits + 1)).otherwise(_trimmed(a, b, edits, lambda x, y: _banded(x, y, edits)))


def _banded(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two texts whose lengths differ by ``edits`` at most.

    Bit-parallel over a band: vertical differences of the band's cells in a
    column are the bits of two numbers. A step takes the next character of
    ``b`` and the window of ``a`` on its diagonal band, and follows the cell on
    the band's lower edge: down the diagonal, then along the last row. Down the
    diagonal it never falls, so a pair that can no longer come back under the
    bound along the last row skips its other steps.
    """
    width = 2 * edits + 2
    full, low, edge = (1 << width) - 1, width - 1 - edits, 1 << (width - 1)
    na, nb = F.char_length(a), F.char_length(b)
    window = F.concat(
        F.array_repeat(F.lit(""), low), F.split(a, ""), F.array_repeat(F.lit(""), F.greatest(nb - na, F.lit(0)) + width)
    )
    both = F.struct(window.alias("w"), F.split(b, "").alias("b"), na.alias("na"))
    text = F.array(both)  # bound once, read in every step

    def run(pair: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            char = F.get(pair["b"], j)
            match = reduce(
                Column.bitwiseOR,
                [F.when(F.get(pair["w"], j + k) == char, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)],
            )
            vp, vn = s["vp"], s["vn"]
            # each bound once by transform over an array of one
            first = F.transform(
                F.array(match),
                lambda m: F.struct(
                    m.bitwiseAND(vp).__add__(vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full)).alias("d0")
                ),
            )
            second = F.transform(
                first,
                lambda x: F.struct(
                    x["d0"].alias("d0"),
                    vn.bitwiseOR(F.lit(full).bitwiseXOR(x["d0"].bitwiseOR(vp))).alias("hp"),
                    x["d0"].bitwiseAND(vp).alias("hn"),
                ),
            )

            def close(x: Column) -> Column:
                down = F.shiftright(x["d0"], 1)
                diagonal = j < pair["na"] - edits
                # on the last row the cell moves up one bit of the band a step
                bit = F.call_function("shiftright", F.lit(edge), (j - (pair["na"] - edits) + 1).cast("int"))
                along = F.when(x["hp"].bitwiseAND(bit) != 0, 1).when(x["hn"].bitwiseAND(bit) != 0, -1).otherwise(0)
                return F.struct(
                    x["hn"].bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(x["hp"]))).alias("vp"),
                    down.bitwiseAND(x["hp"]).alias("vn"),
                    (
                        s["dist"]
                        + F.when(diagonal, F.when(x["d0"].bitwiseAND(F.lit(edge)) != 0, 0).otherwise(1)).otherwise(along)
                    ).alias("dist"),
                )

            return F.when(s["dist"] > hopeless, s).otherwise(F.get(F.transform(second, close), F.lit(0)))

        hopeless = F.lit(2 * edits) + F.greatest(F.size(pair["b"]) - pair["na"], F.lit(0)) + edits
        begin = F.struct(
            F.lit(full ^ ((1 << (width - edits - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(pair["b"]) - 1), begin, step, lambda s: s["dist"])

    found = F.get(F.transform(text, run), F.lit(0))
    return F.least(found, F.lit(edits + 1))


def _odd(line: Column) -> Column:
    """(letters, pairs): bits, folded to 64, of the letters and the pairs of letters that stand an odd number of times."""

    def flipped(bits: Column, at: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")))

    def step(s: Column, c: Column) -> Column:
        return F.struct(
            c.alias("prev"),
            flipped(s["letters"], F.pmod(F.ascii(c), F.lit(64))).alias("letters"),
            flipped(s["pairs"], F.pmod(F.xxhash64(s["prev"], c), F.lit(64))).alias("pairs"),
        )

    zero = F.lit(0).cast("long")
    begin = F.struct(F.lit("").alias("prev"), zero.alias("letters"), zero.alias("pairs"))
    return F.aggregate(F.split(line, ""), begin, step, lambda s: F.struct(s["letters"].alias("letters"), s["pairs"].alias("pairs")))


def _meet(posted: DataFrame, asked: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b), a < b, that meet under a key, leave out no letter both and differ in few odd letters and pairs."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        columns = {name: "id", f"{name}_out": "out", f"{name}_letters": "odd.letters", f"{name}_pairs": "odd.pairs"}
        return rows.select("key", *[F.col(c).alias(n) for n, c in columns.items()])

    def differing(of: str) -> Column:
        return F.bit_count(F.col(f"p_{of}").bitwiseXOR(F.col(f"q_{of}")))

    return (
        side(posted, "p")
        .join(side(asked, "q"), "key")
        .where((F.col("p") != F.col("q")) & (F.col("p_out").bitwiseAND(F.col("q_out")) == 0))
        .where((differing("letters") <= 2 * edits) & (differing("pairs") <= 4 * edits))
        .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    )


def _keyed(long_: DataFrame, edits: int, shortest: int, posted: bool) -> DataFrame:
    """id, line, key, less, at, size: a row per entry that ``_entries`` gives.

    A constant list becomes rows first, so that the rest is plain compiled code.
    """
    parts = edits + 1
    wanted = [(0, n, 0) for n in range(1, parts + 1)] if posted else _offsets(edits)
    names = ("less", "number", "shift")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(w, names, strict=True)]) for w in wanted])
    rows = long_.select("id", "length", "line", F.explode(table).alias("s")).select("id", "length", "line", "s.*")
    other = F.col("length") - F.col("less")
    short, shorts = F.floor(other / parts).cast("int"), F.lit(parts) - other % parts
    number = F.col("number")
    start = (number - 1) * short + F.greatest(number - 1 - shorts, F.lit(0)) + 1
    return (
        rows.withColumn("size", short + F.when(number > shorts, 1).otherwise(0))
        .withColumn("at", start + F.col("shift"))
        .where((other >= shortest) & (F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("length")))
        .withColumn("key", _key(other.cast("int"), number, F.substring("line", F.col("at"), F.col("size"))))
        .select("id", "line", "key", "less", F.col("at").cast("long").alias("at"), F.col("size").cast("long").alias("size"))
    )


def different(lines: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """id, length, line of the different lines that can have links, written."""
    return released(lines.where(F.col("length") >= shortest).select("id", "length", "line").distinct())


def _crowded(entries: DataFrame, most: int) -> DataFrame:
    """Keys that more than ``most`` lines are posted under."""
    return cut(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))


def _split_pairs(texts: DataFrame, crowded: DataFrame, posting: DataFrame, asking: DataFrame, edits: int, shortest: int) -> DataFrame:
    """Pairs that meet under crowded keys, which lines ``posting`` and ``asking`` (ids) share."""

    def split(ids: DataFrame, posted: bool) -> DataFrame:
        rows = _keyed(texts.join(ids, "id", "left_semi"), edits, shortest, posted).join(crowded, "key", "left_semi")
        return cut(_split(rows, crowded, posted, edits).distinct())

    odd = cut(texts.join(posting.union(asking).distinct(), "id", "left_semi").select("id", _odd(F.col("line")).alias("odd")))
    posted, asked = split(posting, True), split(asking, False)
    again = _crowded(posted.where("line IS NOT NULL"), CROWD_LETTERS)
    parts = [
        released(_split(rows, again, side, edits, True).select("id", "key", "out").distinct())
        for rows, side in ((posted, True), (asked, False))
    ]
    return _meet(*[part.join(odd, "id") for part in parts], edits)


def _candidates(texts: DataFrame, edits: int, shortest: int) -> DataFrame:
    """Pairs (a, b) of different lines that share a segment at a fitting place, each once.

    A crowded key stands for the lines posted under it, as null, in the join
    with what is asked for; where it is met, the asking line goes on to be split.
    """
    posted = released(_keyed(texts, edits, shortest, True).select("id", "key"))
    crowded = _crowded(posted, CROWD)
    marks = posted.join(crowded, "key", "left_anti").select("key", F.col("id").alias("p")).unionByName(
        crowded.select("key", F.lit(None).cast("long").alias("p"))
    )
    asked = _keyed(texts, edits, shortest, False).select("key", F.col("id").alias("q"))
    # few lines a key: the postings are the smaller side, and hashed, not sorted
    met = asked.join(marks.hint("shuffle_hash"), "key").where("p IS NULL OR p <> q")
    met = released(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("p").isNull().alias("full")).distinct())
    # written, so that the planner knows how few they are and does not shuffle the text to find them
    posting = cut(posted.join(crowded, "key", "left_semi").select("id").distinct())
    asking = cut(met.where("full").select(F.col("a").alias("id")).distinct())
    more = _split_pairs(texts, crowded, posting, asking, edits, shortest)
    return met.where("NOT full").select("a", "b").unionByName(more).distinct()


def candidates(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """Pairs (a, b) of line ids that share a segment at a fitting place, each once."""
    return _candidates(different(lines, shortest), edits, shortest)


def _ends_near(x: Column, y: Column, edits: int) -> Column:
    """Whether the first and the last characters leave room for ``edits``.

    Cutting two texts within k edits after equally many characters costs k more at most.
    """
    least = F.least(F.char_length(x), F.char_length(y), F.lit(ENDS))
    starts = F.levenshtein(F.substring(x, F.lit(1), least), F.substring(y, F.lit(1), least), 2 * edits)
    ends = F.levenshtein(F.substring(x, -least, least), F.substring(y, -least, least), 2 * edits)
    return (starts >= 0) & (ends >= 0)


def links(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """Pairs (a, b) of line ids within ``edits`` of each other."""
    texts = different(lines, shortest)
    pairs = released(_candidates(texts, edits, shortest))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # few lines are candidates; then the others need not be shuffled to find them
    few = F.broadcast(ids) if ids.count() <= MANY else ids
    wanted = cut(texts.select("id", "line").join(few, "id", "left_semi"))
    near = F.when(
        _ends_near(F.col("x"), F.col("y"), edits), edit_distance(F.col("x"), F.col("y"), edits) <= edits
    ).otherwise(False)
    return cut(
        pairs.join(wanted.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
        .join(wanted.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        .where(near)
        .select("a", "b")
    )


def line_classes(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """A row per different line: doc_id, line_no (first occurrence), copies, links, class_doc_id, class_line_no, id.

    copies: occurrences of just this line; links: other lines within ``edits``;
    class_*: first occurrence of any line of its class.
    """
    return _classes(lines_of(docs), edits, shortest)


def line_members(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """A row per line of every row: doc_id, line_no, and copies, links, class_doc_id, class_line_no of its text."""
    lines = lines_of(docs)
    classes = _classes(lines, edits, shortest).drop("doc_id", "line_no")
    return lines.select("doc_id", "line_no", "id").join(classes.hint("merge"), "id").select(
        "doc_id", "line_no", "copies", "links", "class_doc_id", "class_line_no"
    )


def _classes(lines: DataFrame, edits: int, shortest: int) -> DataFrame:
    found = links(lines, edits, shortest)
    comp = cut(components(found))
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    first = cut(lines.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies")))
    # linked lines are few: written, so that the planner can send them to the others
    members = cut(comp.join(degree, "id")).join(first.select("id", "first"), "id")
    members = cut(members)
    heads = members.groupBy("comp").agg(F.min("first").alias("head"))
    linked = cut(members.join(heads, "comp").select("id", "links", "head"))
    return first.join(linked, "id", "left").select(
        "first.doc_id",
        F.col("first.line_no").alias("line_no"),
        "copies",
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("head", "first")["doc_id"].alias("class_doc_id"),
        F.coalesce("head", "first")["line_no"].alias("class_line_no"),
        "id",
    )


def keep_first(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text, lines, kept: each document without lines whose class stood earlier.

    Documents are named by doc_id; rows that share one are put together.
    """
    classes = line_classes(docs, edits, shortest).select("id", "class_doc_id", "class_line_no")
    here = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no"))
    kept = lines_of(docs).join(classes, "id").where(here)
    texts = kept.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("kept")
    )
    count = lines_of(docs).groupBy("doc_id").agg(F.count("*").alias("lines"))
    return (
        docs.select("doc_id").distinct().alias("d")
        .join(count.alias("c"), F.expr("d.doc_id <=> c.doc_id"), "left")
        .join(texts.alias("t"), F.expr("d.doc_id <=> t.doc_id"), "left")
        .select(
            "d.doc_id",
            F.coalesce(F.array_join(F.col("kept.line"), "\n"), F.lit("")).alias("text"),
            F.coalesce("lines", F.lit(0)).alias("lines"),
            F.coalesce(F.size("kept"), F.lit(0)).alias("kept"),
        )
    )
