"""Register texts to records: segments at code lines, cards inside them, fields out of the cards.

All steps are windows, aggregates and column expressions over a table of lines.
A document's lines are ordered within it; documents spread over the cluster.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import patterns as P
from ..operators.rows import keep_first
from ..operators.segments import joined_lines, segmented

#: Texts from which the search for object anchors takes over where no segment gave a card.
ANCHOR_CHARS = 12_000
#: How far above an object its code may stand.
HORIZON = 14_000


def lines(docs: DataFrame) -> DataFrame:
    """(doc, source_part, pos, at, line): the preprocessed text's lines; ``at`` is the offset of the line's start."""
    text = docs.select("doc", "source_part", X.preprocess(F.col("text")).alias("text"))
    each = text.select("doc", "source_part", F.length("text").alias("chars"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).withColumn("line", X.strip(F.col("line")))


def _bodies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``owners``, the owner labels of the card so far, and ``body``, the line without the label that it begins with."""
    w = Window.partitionBy(*keys, "card").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("is_owner", F.col("line").rlike(P.OWNER_START))
    marked = marked.withColumn("owners", F.sum(F.col("is_owner").cast("int")).over(w))
    first_owner = F.col("is_owner") & (F.col("owners") == 1)
    body = F.when(F.col("is_object"), X.strip(F.regexp_extract("line", P.OBJECT_START, 2))).when(first_owner, X.strip(F.regexp_extract("line", P.OWNER_START, 1))).otherwise(F.col("line"))
    return marked.withColumn("body", body)


def _cards(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per card of ``rows`` (one segment each group of keys), with object and owner texts.

    A card begins at an object label; its owner's text begins at the first owner
    label after it, and takes all that follows.
    """
    return (
        _bodies(rows, keys).groupBy(*keys, "card")
        .agg(
            F.min("pos").alias("pos"), F.min("at").alias("at"), F.first(F.when(F.col("is_object"), F.regexp_extract("line", P.OBJECT_START, 1)), True).alias("id"),
            joined_lines("body", "pos", F.col("owners") == 0).alias("object_blob"), joined_lines("body", "pos", F.col("owners") > 0).alias("owner_blob"),
        )
    )


def segment_cards(rows: DataFrame) -> DataFrame:
    """Cards of the segments that begin at code lines."""
    coded = rows.withColumn("coded", X.code_line(F.col("line")))
    seg = segmented(coded, ["doc"], "pos", F.col("coded").isNotNull(), "seg")
    w = Window.partitionBy("doc", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumn("is_object", F.col("coded").isNull() & F.col("line").rlike(P.OBJECT_START))
    seg = seg.withColumn("card", F.sum(F.col("is_object").cast("int")).over(w))
    heads = seg.where("card = 0").withColumn("words", F.coalesce("coded.rest", "line")).groupBy("doc", "seg").agg(
        F.max("coded.code").alias("waste_code"), joined_lines("words", "pos", F.lit(True), " ").alias("waste_type_name")
    )
    cards = _cards(seg.where("card > 0"), ["doc", "source_part", "seg"])
    return cards.join(heads, ["doc", "seg"]).select("doc", "source_part", "pos", "id", "waste_code", "waste_type_name", "object_blob", "owner_blob")


def _anchored(rows: DataFrame) -> DataFrame:
    """``rows`` with object labels, the number of the card so far, and the last code above each line."""
    labelled = rows.withColumns({"is_object": F.col("line").rlike(P.OBJECT_START), "code": F.try_element_at(F.regexp_extract_all("line", F.lit(r"(?<![0-9])[0-9]{7}(?![0-9])"), F.lit(0)), F.lit(-1))})
    above = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("code").isNotNull(), F.struct("code", "at", "pos")), True).over(above)
    return labelled.withColumns({"last": last, "card": F.sum(F.col("is_object").cast("int")).over(upto)})


def routed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``route``: which of segments, anchors and blocks gives its document's cards.

    Segments do if an object label follows a code line.  Anchors do in a long
    text if, from the first label with a code above it within the horizon on,
    some card has a text.  Told by windows over a document's lines, so that no
    way of reading is planned inside another.
    """
    doc = Window.partitionBy("doc")
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = _bodies(_anchored(rows.withColumn("is_code", X.code_line(F.col("line")).isNotNull())), ["doc"])
    label = F.col("is_object") & ~F.col("is_code")
    marked = marked.withColumns({
        "in_segment": label & F.max("is_code").over(upto), "has_code": F.max(F.coalesce(F.col("is_object") & (F.col("at") - F.col("last.at") <= HORIZON), F.lit(False))).over(upto),
    })
    anchored = (F.col("chars") > ANCHOR_CHARS) & F.max(F.col("has_code") & (F.col("body") != "")).over(doc)
    route = F.when(F.max("in_segment").over(doc), "segments").when(anchored, "anchors").otherwise("blocks")
    return marked.select(*rows.columns, route.alias("route"))


def anchor_cards(rows: DataFrame) -> DataFrame:
    """Cards at object labels anywhere, with the last code above them within the horizon.

    Where none stands that near, the code of the card before goes on.
    """
    labelled = _anchored(rows)
    cards = _cards(labelled.where("card > 0"), ["doc", "source_part"])
    above = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    heads = labelled.where("is_object").withColumn("near", F.when(F.col("at") - F.col("last.at") <= HORIZON, F.col("last")))
    heads = heads.withColumn("near", F.coalesce("near", F.last("near", True).over(above))).select("doc", "card", F.col("near.code").alias("waste_code"), F.col("near.pos").alias("code_pos"), F.col("pos").alias("head_pos"))
    between = heads.join(rows.select("doc", F.col("pos").alias("p"), "line"), "doc").where("p > code_pos and p < head_pos")
    types = between.groupBy("doc", "card").agg(joined_lines("line", "p", F.lit(True), " ").alias("words"))
    kind = F.coalesce(F.nullif(F.substring("words", 1, 900), F.lit("")), F.lit("—"))
    joined = cards.join(heads, ["doc", "card"]).join(types, ["doc", "card"], "left").where("waste_code is not null and (object_blob <> '' or owner_blob <> '')")
    return joined.select("doc", "source_part", "pos", "id", "waste_code", kind.alias("waste_type_name"), "object_blob", "owner_blob")


def label_block_cards(rows: DataFrame) -> DataFrame:
    """Cards of the layout whose labels stand as column heads, ids and codes on lines of their own.

    The id is the nearest line of 3 to 6 digits among the nine above a pair of
    labels; the code the nearest seven-digit line above that looks like one, else
    the nearest of any kind.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    solid = rows.where("line <> ''").withColumn("n", F.row_number().over(w)).withColumn("low", F.lower("line"))
    nxt = lambda k: F.lead("line", k).over(w)
    other = F.when(F.col("low") == "собственник", "объект").when(F.col("low") == "объект", "собственник")
    verdict = F.lit(None).cast("boolean")
    for k in range(5, 0, -1):  # the nearest telling line of the next five decides
        x = nxt(k)
        skip = x.isNull() | X.noise_line(x) | F.lower(x).isin("собственник", "объект") | x.rlike(r"^\d{1,7}$")
        verdict = F.when(skip, verdict).when(x.rlike(P.POSTCODE), False).when(x.rlike("[A-Za-zА-Яа-яЁё]"), True).otherwise(verdict)
    solid = solid.withColumns({"is_pair": F.coalesce(F.lower(nxt(1)) == other, F.lit(False)), "is_code": F.col("line").rlike(r"^\d{7}$"), "likely": F.coalesce(verdict, F.lit(False))})
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda when: F.last(F.when(when, F.struct("n", "line")), True).over(above)
    solid = solid.withColumns({
        "id_at": last(F.col("line").rlike(r"^\d{3,6}$")), "sure": last(F.col("is_code") & F.col("likely")), "any": last(F.col("is_code")),
        "next_pair": F.min(F.when(F.col("is_pair"), F.col("n"))).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    pairs = solid.where(F.col("is_pair") & (F.col("n") - F.col("id_at.n") <= 9)).withColumn("code_at", F.coalesce("sure", "any")).where("code_at is not null").select(
        "doc", "source_part", "pos", F.col("n").alias("pair"), "next_pair", F.col("id_at.n").alias("id_n"), F.col("id_at.line").alias("id"), F.col("code_at.n").alias("code_n"), F.col("code_at.line").alias("waste_code")
    )
    near = pairs.join(solid.select("doc", "n", "line", "low"), "doc").where(
        "n >= least(id_n - 10, code_n + 1) and n < coalesce(next_pair, 9223372036854775807) and n <> pair and n <> pair + 1"
    ).where(~X.noise_line(F.col("line")))
    bare, label = F.col("line").rlike(r"^\d{1,7}$"), F.col("low").isin("собственник", "объект")
    place = (
        F.when((F.col("n") >= F.col("id_n") - 10) & (F.col("n") < F.col("id_n")) & ~bare & ~label, 1)
        .when((F.col("n") > F.col("id_n")) & (F.col("n") < F.col("pair")) & ~F.col("line").rlike(r"^\d{1,2}$") & ~label, 2)
        .when(F.col("n") > F.col("pair"), 3)
    )
    near = near.withColumn("place", place)
    in_body = Window.partitionBy("doc", "pair", "place").orderBy("n")
    body = near.where("place is not null").withColumns({"left": F.count("*").over(Window.partitionBy("doc", "pair", "place")) - F.row_number().over(in_body) + 1, "first": F.row_number().over(in_body) == 1})
    cut = F.max(F.when((F.col("place") == 3) & F.col("line").rlike(r"^\d{3,6}$") & (F.col("left") <= 5) & ~F.col("first"), F.col("n"))).over(Window.partitionBy("doc", "pair"))
    body = body.withColumn("cut", cut).where("place < 3 or cut is null or n < cut")
    items = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "n", "line"))), lambda x: x["line"]), 1, 180)
    blobs = body.groupBy("doc", "pair").agg(items.alias("all_lines"))
    types = near.where("n > code_n and n < pair").where(~F.col("line").rlike(r"^\d{3,7}$")).groupBy("doc", "pair").agg(joined_lines("line", "n", F.lit(True), " ").alias("words"))
    joined = pairs.join(blobs, ["doc", "pair"]).join(types, ["doc", "pair"], "left")
    cards = joined.select(
        "doc", "source_part", "pos", "id", "waste_code", F.coalesce(F.nullif(F.substring("words", 1, 900), F.lit("")), F.lit("—")).alias("waste_type_name"),
        F.array_join("all_lines", "\n").alias("object_blob"), guessed_owner(F.col("all_lines")).alias("owner_blob"),
    )
    return keep_first(cards, [F.col("doc"), F.col("waste_code"), F.col("id")], [F.col("pos")])


def guessed_owner(rows: Column) -> Column:
    """The first line with a legal form and those that go on with it."""
    begin = F.struct(F.lit(0).alias("phase"), F.lit("").alias("text"))
    ends = lambda x: X.noise_line(x) | F.lower(x).isin("собственник", "объект") | x.rlike(r"^\d{3,7}$") | x.rlike(P.POSTCODE)

    def step(acc: Column, x: Column) -> Column:
        longer = F.concat(acc["text"], F.lit("\n"), x)
        return (
            F.when((acc["phase"] == 0) & x.rlike(P.LEGAL_FORM), F.struct(F.lit(1).alias("phase"), x.alias("text")))
            .when((acc["phase"] == 1) & (ends(x) | (F.length(longer) > 280)), F.struct(F.lit(2).alias("phase"), acc["text"].alias("text")))
            .when(acc["phase"] == 1, F.struct(F.lit(1).alias("phase"), longer.alias("text")))
            .otherwise(acc)
        )

    return F.aggregate(rows, begin, step)["text"]


@lru_cache(maxsize=1)
def _steps(gateway: object) -> list[dict[str, Column]]:
    """The fields' columns, step by step; each costly one has a name, so that it is worked out once.

    They refer to columns by name alone, and building them takes thousands of
    calls to Java, so they are kept for the next import over the same gateway.
    """
    obj, own, name, canon, address = (F.col(c) for c in ("object_blob", "owner_blob", "_name", "_canon", "_address"))
    telling = canon.rlike(P.EQUIPMENT)
    better = (name == "") | (telling & (~name.rlike(P.EQUIPMENT) | (F.contains(name, canon) & (F.length(name) >= F.length(canon) + 18)) | (F.length(canon) > F.length(name))))
    any_address = F.coalesce(F.nullif(F.col("_obj.address"), F.lit("")), F.nullif(F.col("_own.address"), F.lit("")), own)
    return [
        {"_obj": X.name_and_address(obj), "_own": X.name_and_address(own), "_canon": X.canonical_object(obj, F.col("waste_type_name"))},
        {"_name": X.clean_object_name(F.col("_obj.name"), F.col("waste_type_name"))},
        {"object_name": F.coalesce(F.nullif(F.when((canon != "") & better, canon).otherwise(name), F.lit("")), F.lit("—")), "_address": X.trim_tail(any_address)},
        {"_address": F.when(F.length(address) < 8, F.coalesce(F.nullif(X.postal_lines(obj, own), F.lit("")), any_address)).otherwise(address)},
        {"_address": X.with_locality(address, obj, own)},
        {"_address": X.dedupe_locality(X.repair_address(address, own, obj))},
        {"address": X.clean_address(X.collapse_commas(address))},
        {
            "id": F.col("id").cast("int"), "owner": X.owner_name(own, obj, F.col("address"), F.col("_own.name")),
            "accepts_external_waste": X.accepts_external(obj), "phones": X.phones(obj, own),
        },
    ]


def assembled(cards: DataFrame) -> DataFrame:
    """Records of the cards: id, owner, object_name, waste_code, waste_type_name, accepts_external_waste, address, phones, source_part."""
    df = cards
    for step in _steps(SparkContext._gateway):
        df = df.withColumns(step)
    return df.select("doc", "pos", "id", "owner", "object_name", "waste_code", "waste_type_name", "accepts_external_waste", "address", "phones", "source_part")


def parse(docs: DataFrame) -> DataFrame:
    """Records of register texts (doc, source_part, text), in the order doc, pos.

    Texts whose segments give no card fall back on anchors if they are long, and
    then on label blocks.
    """
    rows = routed(lines(docs))
    cards = segment_cards(rows.where("route = 'segments'"))
    anchors = anchor_cards(rows.where("route = 'anchors'"))
    blocks = label_block_cards(rows.where("route = 'blocks'"))
    every = cards.unionByName(anchors).unionByName(blocks)
    return assembled(every.repartition("doc", "pos"))  # spreads a large document's cards, and keeps the fields in one plan
