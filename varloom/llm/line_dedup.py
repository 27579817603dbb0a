"""Line dedup by a segment-partition edit join (operator 1), with DataFrame functions alone.

Equal lines are one line first. A line is cut into EDITS + 1 parts; a line within EDITS edits of it
holds one of them unchanged, near its place (the multi-match-aware bounds). The start of each part is
its segment. Segments are sized and placed by the class of the line's length, so that a line probes
the same few substrings for all lengths down to EDITS less than its own, by the hash of part, class
and substring. Keys that many lines of a sample share are hot: there the lines go along with their
keys, and pairs are rejected inside the join, by letter counts and then by edit distance. Where
segments get too short to tell lines apart, lines meet by what EDITS deletions at most leave of them.
What is left is verified by banded bit-parallel edit distance.

Links tell all lines within EDITS. A line goes for another one only over a close link, of one edit in
CLOSE characters at most, and only for a line that itself stays: no chain of links takes lines along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import cut, drop_cut, table

#: Edits between linked lines, and the length from which lines are joined by edits; shorter ones only where equal.
EDITS, MIN_CHARS = 2, 1
#: A link is close where the shorter line has this many characters for each edit.
CLOSE = 10
#: Lines of fewer characters meet others by deletions, not by segments.
SHORT = 12
#: One in SAMPLE lines tells which keys are hot: those that HOT of them share. Either way is exact.
SAMPLE, HOT = 16, 4
#: Tables of ids and keys are broadcast up to this many rows, and joined beyond.
BROADCAST_ROWS = 100_000
#: Characters that a signature counts, modulo 4 and in Gray code: 31 at most.
COUNTED = "etaoinsrhldcumfpgwybvkxjqz .,01"


def line_id(line: Column) -> Column:
    """128 bits, as a struct of two longs."""
    return F.struct(F.xxhash64(line).alias("hi"), F.xxhash64(F.lit(1), line).alias("lo"))


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rid (of id and text), pos, line, id; a document without lines is one row of nulls.

    Lines are split at line feeds; white space around them is dropped, and blank ones have no row.
    """
    cells = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(" \t\r")).alias("line"))), lambda c: c["line"] != "")
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("rid"), F.explode_outer(cells).alias("c"))
    return rows.select("doc_id", "rid", "c.pos", "c.line", F.when(F.col("c.line").isNotNull(), line_id(F.col("c.line"))).alias("id"))


def length_class(n: Column) -> Column:
    """Lengths from a value on, a step of a sixteenth to an eighth of them wide (4 at least)."""
    step = F.greatest(F.lit(4.0), F.pow(F.lit(2.0), F.floor(F.log2(n)) - 3)).cast("int")
    return n - F.pmod(n, step)


def segment_keys(c: Column, edits: int = EDITS) -> Column:
    """array<struct<key, kept>>: the keys under class c of column line of n characters. kept ones, of
    the line's own class, are those that it is met by; the others only probe."""
    size = F.floor(c / (edits + 1)).cast("int")
    out = []
    for i in range(edits + 1):
        at = F.col("n") - size if i == edits else F.floor((c - size) * i / edits).cast("int")
        for shift in [0] if i == edits else range(-min(i, edits - i), i + 1):
            key = F.xxhash64(F.lit(i), c, F.substring(F.col("line"), at + shift + 1, size))
            out.append(F.struct(key.alias("key"), (F.lit(shift == 0) & (c == length_class(F.col("n")))).alias("kept")))
    return F.array(*out)


def with_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Adds key and kept to rows of line and n: a row for each key that a line of its length has."""
    classes = F.array_distinct(F.array(*[length_class(F.col("n") - d) for d in range(edits + 1)]))
    rows = lines.select("*", F.explode(classes).alias("_class"))
    return rows.select("*", F.explode(segment_keys(F.col("_class"), edits)).alias("_k")).select(*lines.columns, "_k.key", "_k.kept")


def signature(line: Column) -> Column:
    """Two bits for each of the COUNTED characters. An edit changes two counts by one at most, so
    signatures of lines within the edits differ in 2 * edits bits at most."""
    marks = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(2 * i).alias("at")) for i, c in enumerate(COUNTED)])
    count = lambda x: F.pmod(F.octet_length(line) - F.octet_length(F.replace(line, x["c"], F.lit(""))), F.lit(4))
    gray = lambda n: n.bitwiseXOR(F.shiftright(n, 1)).cast("long")
    return F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", gray(count(x)), x["at"])))


def deletion_keys(edits: int = EDITS) -> Column:
    """The hashes of what a line leaves after the edits in deletions or fewer; lines within the edits share one."""
    without = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    levels = [F.array("line")]
    for _ in range(edits):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], without))))
    return F.transform(F.array_distinct(F.concat(*levels)), lambda x: F.xxhash64(x))


def banded_distance(left: Column, right: Column, edits: int = EDITS) -> Column:
    """Edit distance of two texts, right up to edits (and above edits where it is above), for
    lengths that differ by edits at most and reach 2 * edits + 1. The texts are split once, in a
    let(): a filter that is pushed below a projection would else split them for each character.

    A column of the matrix is a word of 2 * edits + 1 bits around the diagonal: vp and vn are its
    vertical steps up and down. The value at the lower edge of the band is followed along the
    diagonal to the last row, and along that row to the end.
    """
    pair = F.array(F.struct(characters(left).alias("s"), characters(right).alias("t")))
    return F.get(F.transform(pair, lambda x: _banded(x["s"], x["t"], edits)), F.lit(0))


def _banded(a: Column, b: Column, edits: int) -> Column:
    w = 2 * edits + 1
    ones, edge = (1 << w) - 1, 1 << (w - 1)
    turn = F.size(a) - edits
    long = lambda v: F.lit(v).cast("long")
    state = lambda vp, vn, d: F.struct(vp.alias("vp"), vn.alias("vn"), d.alias("d"))

    def step(s: Column, j: Column) -> Column:
        """Bit arithmetic in one pass; each let() binds what is used more than once."""
        let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
        pm = F.lit(0).cast("long")
        for bit in range(w):
            at = j + (bit - edits)
            pm = pm + F.when((at >= 0) & (F.get(a, F.greatest(at, F.lit(0))) == F.get(b, j)), long(1 << bit)).otherwise(long(0))
        flip = lambda x: x.bitwiseXOR(long(ones))

        def rest(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"])))
            hn, down = d0.bitwiseAND(s["vp"]), F.shiftright(d0, 1)
            along = F.call_function("shiftright", long(edge), (j - turn + 1).cast("int"))
            bit = lambda x, mask: F.when(x.bitwiseAND(mask) != 0, 1).otherwise(0)
            d = s["d"] + F.when(j < turn, 1 - bit(d0, long(edge))).otherwise(bit(hp, along) - bit(hn, along))
            return state(hn.bitwiseOR(flip(down.bitwiseOR(hp))), down.bitwiseAND(hp), d)

        def zero(p: Column) -> Column:
            return p.bitwiseAND(s["vp"]).__add__(s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(p).bitwiseOR(s["vn"]).bitwiseAND(long(ones))

        # The value never falls along the diagonal and falls by 2 * edits at most along the last row.
        return F.when(s["d"] > 3 * edits, s).otherwise(let(let(pm, zero), rest))

    first = state(long(ones ^ ((1 << edits) - 1)), long(0), F.lit(edits))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), first, step, lambda s: s["d"])


def characters(text: Column) -> Column:
    """A text's characters as an array of strings."""
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _line_cells(lines: DataFrame, edits: int) -> DataFrame:
    """The lines without their texts, but for short and sampled ones."""
    some = (F.length("line") < SHORT + edits) | (F.pmod(F.col("id.lo"), F.lit(SAMPLE)) == 0)
    return lines.withColumn("line", F.when(some, F.col("line")))


def _close(a: Column, b: Column, edits: int) -> Column:
    """Within the edits: the built-in distance rejects, the banded one decides on what is left."""
    tiny = F.least(F.length(a), F.length(b)) < 2 * edits + 1
    return (F.levenshtein(a, b, edits) >= 0) & F.when(tiny, True).otherwise(banded_distance(a, b, edits) <= edits)


def _is_close(a: Column, b: Column, edits: int) -> Column:
    """Of two texts within the edits: whether the shorter one has CLOSE characters for each edit."""
    return F.levenshtein(a, b, edits) * CLOSE <= F.least(F.length(a), F.length(b))


def edit_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, cells: DataFrame | None = None) -> DataFrame:
    """(a, b, close) of ids of different lines within the edits, each pair once. cells: _line_cells(), written."""
    cells = cut(_line_cells(lines, edits)) if cells is None else cells
    some = cells.where(F.length("line") >= min_chars).select("line").distinct().withColumn("n", F.length("line"))
    sampled = with_keys(some.where((F.col("n") >= SHORT) & (F.pmod(line_id(F.col("line"))["lo"], F.lit(SAMPLE)) == 0)), edits)
    hot = cut(sampled.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("hot")).where(F.col("hot") >= HOT))

    distinct = lines.where(F.length("line") >= max(SHORT, min_chars)).select("line").distinct().withColumn("n", F.length("line"))
    keyed = with_keys(distinct.select("line", "n", F.xxhash64("line").alias("id")), edits).join(_small(hot), "key", "left")
    text = F.when(F.col("hot").isNotNull(), F.col("line"))
    rows = keyed.select("key", "id", "n", "kept", text.alias("line"), F.when(F.col("hot").isNotNull(), signature(F.col("line"))).alias("sig"))
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "kept", "line", "sig")]) for s in "ab")
    # A row is met by its kept keys alone; the test names both sides, so that both read one exchange.
    longer = F.col("n_b") - F.col("n_a")
    fits = F.when(F.col("kept_a"), longer.between(0, edits) & ((longer > 0) | (F.col("id_a") < F.col("id_b")))).otherwise(F.col("kept_b") & (F.col("n_b") < 0))
    alike = (F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) <= 2 * edits) & (F.levenshtein("line_a", "line_b", edits) >= 0)
    met = a.join(b, "key").where(fits & F.when(F.col("sig_a").isNull(), True).otherwise(alike))
    met = cut(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())

    asked = cut(met.select(F.explode(F.array("a", "b")).alias("hi")).distinct())
    texts = lines.where("id is not null").select("id", "id.hi", "line").join(_small(asked), "hi").distinct()
    side = lambda c: texts.select(F.col("hi").alias(c), F.col("id").alias(f"{c}_id"), F.col("line").alias(f"{c}_line"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where((F.col("a_id") != F.col("b_id")) & _close(F.col("a_line"), F.col("b_line"), edits))
    pairs = pairs.select("a_id", "b_id", _is_close(F.col("a_line"), F.col("b_line"), edits).alias("close"))

    short = cut(some.where(F.col("n") < SHORT + edits).select("line", F.explode(deletion_keys(edits)).alias("key")))
    one, other = short.withColumnRenamed("line", "a_line"), short.withColumnRenamed("line", "b_line")
    near = one.join(other, "key").where("a_line < b_line").select("a_line", "b_line").distinct().where(_close(F.col("a_line"), F.col("b_line"), edits))
    every = pairs.union(near.select(line_id(F.col("a_line")), line_id(F.col("b_line")), _is_close(F.col("a_line"), F.col("b_line"), edits)))
    links = cut(every.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "close").distinct())
    for done in (hot, met, asked, short):
        drop_cut(done)
    return links


def _losers(edges: DataFrame) -> DataFrame:
    """(id) of the lines that go, of edges u -> v where u is before v: v goes where such a u stays.

    A round decides on all lines that nothing undecided is before, and on those after them. Hashes
    order the edges, so the rounds grow with the logarithm of the lines, however links are chained.
    """
    edges, gone = cut(edges), []
    while edges.limit(1).count():
        stays = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        lost = cut(edges.join(stays, "u").select(F.col("v").alias("id")).distinct())
        open_ = edges.join(lost, F.col("u") == F.col("id"), "left_anti").join(lost, F.col("v") == F.col("id"), "left_anti")
        left = cut(open_)
        drop_cut(edges)
        edges, gone = left, [*gone, lost]
    drop_cut(edges)
    out = edges.select(F.col("u").alias("id")).limit(0)
    for lost in gone:
        out = out.union(lost)
    return out


def line_classes(cells: DataFrame, links: DataFrame) -> DataFrame:
    """id, class (a line's id), links (other lines within the edits), head_doc, head_rid and head_pos of
    the class's first line, of the lines that are met more than once or have links; any other line is
    its own class.

    Of close lines, those stay that are met before all lines close to them, and what is close to one
    of these goes; of the others, the smaller id stays before the larger. So each line that goes is
    close to one that stays, whose class it has (the one met first, where there are several), and no
    two lines that stay are close. First is by doc_id (null first), then text hash and position.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    met = cells.where("id is not null").groupBy("id").agg(F.min(F.struct("doc_id", "rid", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    named = cut(met.join(degree, "id", "left").where("n > 1 or links > 0").withColumn("links", F.coalesce("links", F.lit(0))))
    first = named.select("id", "first")
    close = links.where("close")
    both = close.select(F.col("a").alias("u"), F.col("b").alias("v")).union(close.select("b", "a"))
    both = both.join(first.withColumnsRenamed({"id": "u", "first": "u_first"}), "u").join(first.withColumnsRenamed({"id": "v", "first": "v_first"}), "v")
    both = cut(both)
    heads = cut(both.groupBy("u").agg(F.bool_and(F.col("u_first") < F.col("v_first")).alias("head")).where("head").select(F.col("u").alias("id")))
    early = cut(both.join(heads, F.col("u") == F.col("id")).select(F.col("v").alias("id")).distinct())
    rest = both.where("u < v").select("u", "v")
    for decided in (heads, early):
        rest = rest.join(decided, F.col("u") == F.col("id"), "left_anti").join(decided, F.col("v") == F.col("id"), "left_anti")
    gone = cut(early.union(_losers(rest)))
    rule = both.join(gone, F.col("v") == F.col("id")).join(gone.withColumnRenamed("id", "lost"), F.col("u") == F.col("lost"), "left_anti")
    rule = rule.groupBy(F.col("v").alias("id")).agg(F.min(F.struct("u_first", "u")).alias("rule"))
    every = named.join(rule, "id", "left").withColumn("head", F.coalesce("rule.u_first", "first"))
    out = cut(every.select("id", F.coalesce("rule.u", "id").alias("class"), "links", F.col("head.doc_id").alias("head_doc"), F.col("head.rid").alias("head_rid"), F.col("head.pos").alias("head_pos")))
    for done in (named, both, heads, early, gone):
        drop_cut(done)
    return out


def judge_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, rid, cells (pos, class, links, kept) in order of pos, for each distinct (doc_id, text).

    A line is kept where it is the first of its class, a line equal or close to it goes. Null, empty and blank texts have no cells;
    rows that repeat id and text are one document. Other columns are ignored. No rows: no rows.
    """
    lines = document_lines(docs, key, text)
    cells = cut(_line_cells(lines, edits))
    classes = line_classes(cells, edit_links(lines, edits, min_chars, cells))
    told = cells.drop("line").join(classes, "id", "left")
    kept = F.col("head_rid").isNull() | (F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("rid") == F.col("head_rid")) & (F.col("pos") == F.col("head_pos")))
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), kept.alias("kept")))
    return told.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(cell)).alias("cells"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document (of id and text): its lines, those dropped, the links of its lines, and the
    class of each line, as 32 hex digits. Null, empty and blank texts have no lines; ties go to the
    smaller doc_id; repeated rows are one; an empty table gives no rows."""
    cells = judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = lambda x: F.lower(F.concat(F.lpad(F.hex(x["hi"]), 16, "0"), F.lpad(F.hex(x["lo"]), 16, "0")))
    return cells.select("doc_id", F.size("cells").cast("long").alias("n_lines"), F.size(F.filter("cells", lambda c: ~c["kept"])).cast("long").alias("n_dropped"), F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["links"]).alias("n_links"), F.transform("cells", lambda c: digits(c["class"])).alias("class_ids"))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """The documents without their repeated lines, n_chars set anew where there is such a column.

    A document all of whose lines are repeats goes where whole is set, and is left as it is where not.
    Other columns stay as they are, whatever their names.
    """
    cells = judge_lines(docs, key, text)
    gone = cells.select("doc_id", "rid", F.transform(F.filter("cells", lambda c: ~c["kept"]), lambda c: c["pos"]).alias("gone"), F.size("cells").alias("n")).where((F.size("gone") > 0) & (F.lit(whole) | (F.size("gone") < F.col("n"))))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("at"), F.col(text).alias("text"), F.xxhash64(key, text).alias("hash"))
    rows = rows.join(gone, (F.col("hash") == F.col("rid")) & F.col("at").eqNullSafe(F.col("doc_id")), "left").where("gone is null or size(gone) < n")
    parts = F.split(F.col("text"), "\n", -1)
    rows = rows.withColumn("parts", F.when(F.col("gone").isNotNull(), parts))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda i: F.get(F.col("parts"), i)), "\n")
    rows = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    fields = {c: F.col("row").getField(c) for c in docs.columns}
    fields[text] = F.when(F.col("gone").isNotNull(), F.col("left")).otherwise(fields[text])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("gone").isNotNull(), F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return rows.select(*[v.alias(c) for c, v in fields.items()])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from every document, and with them the documents that hold nothing else.
    Documents without lines (null, empty and blank texts) stay as they are, and so do repeated rows."""
    return drop_repeats(docs, whole=True)


SQL: dict[str, str] = {}
QUERIES = {"op1_line_dedup": op1_line_dedup}
