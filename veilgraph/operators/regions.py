"""Detected regions against what was read in them: what to read again, what to report as a region, and whose it is.

spans: photo_id, span_index, text, box, conf; detections: photo_id, det_index, name, box, conf; findings: photo_id,
finding, kind, severity, certainty, box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G
from veilgraph.operators.grid import centred, overlapping

# ---- fixed values: document classes, those covered when unread, those that always hold personal data; reading limits
DOCUMENTS = ["id_card", "name_tag", "card", "waybill", "screen", "health_item"]
COVER_WHEN_UNREAD = ["id_card", "name_tag", "card"]
ALWAYS_PERSONAL = ["waybill", "id_card", "name_tag", "card", "health_item"]
CONFIDENT, LEAST_READ, ENOUGH_READ, SMALL_TEXT, MOST_REREAD, TARGET_SIDE, MOST_UPSCALE = 0.75, 6, 40, 22, 4, 1600, 3.0
CODES = ["qr", "barcode"]


def is_document(name: Column) -> Column:
    return name.isin(DOCUMENTS)


def confident_chars(text: Column, conf: Column) -> Column:
    return F.coalesce(F.sum(F.when(conf >= CONFIDENT, F.length(F.replace(text, F.lit(" "), F.lit(""))))), F.lit(0)).cast("long")


def read_in_documents(spans: DataFrame, detections: DataFrame) -> DataFrame:
    """(photo_id, det_index, name, box, conf, inside, chars, height): what was read in each document, and the median
    height of what was read surely (null: nothing)."""
    docs = detections.where(is_document(F.col("name"))).select("photo_id", "det_index", F.col("box").alias("b"))
    words = spans.select("photo_id", "text", F.col("conf").alias("sure"), F.col("box").alias("a"))
    sure = F.col("sure") >= CONFIDENT
    per = centred(words, docs).groupBy("photo_id", "det_index").agg(F.count(F.lit(1)).alias("inside"), confident_chars(F.col("text"), F.col("sure")).alias("chars"), F.median(F.when(sure, F.col("a.h"))).alias("height"))
    kept = detections.where(is_document(F.col("name"))).select("photo_id", "det_index", "name", "box", "conf")
    return kept.join(per, ["photo_id", "det_index"], "left").fillna(0, ["inside", "chars"])


def crop_box(box: Column, width: int, height: int) -> Column:
    """The box with a margin of 4 % and 8 pixels, within the image."""
    mx, my = F.floor(box["w"] * 0.04) + 8, F.floor(box["h"] * 0.04) + 8
    x0, y0 = F.greatest(F.lit(0), box["x"] - mx), F.greatest(F.lit(0), box["y"] - my)
    x1, y1 = F.least(F.lit(width), box["x"] + box["w"] + mx), F.least(F.lit(height), box["y"] + box["h"] + my)
    return G.box(x0, y0, F.greatest(F.lit(1), x1 - x0), F.greatest(F.lit(1), y1 - y0))


def upscale(crop: Column) -> Column:
    return F.least(F.lit(MOST_UPSCALE), F.greatest(F.lit(1.0), F.lit(float(TARGET_SIDE)) / F.greatest(crop["w"], crop["h"])))


def to_original(box: Column, crop: Column, scale: Column) -> Column:
    """A box found in the enlarged crop, in the photo's own pixels."""
    side = lambda c: F.greatest(F.lit(1), F.bround(box[c] / scale).cast("int"))
    at = lambda c: F.floor(box[c] / scale + crop[c])
    return G.box(at("x"), at("y"), side("w"), side("h"))


def to_read_again(spans: DataFrame, detections: DataFrame, width: int, height: int, most: int = MOST_REREAD) -> DataFrame:
    """(photo_id, det_index, crop, scale): the surest documents of which too little or too small text was read."""
    read = read_in_documents(spans, detections)
    needed = read.where((F.col("chars") < ENOUGH_READ) | F.col("height").isNull() | (F.col("height") < SMALL_TEXT))
    order = Window.partitionBy("photo_id").orderBy(F.desc("conf"), "det_index")
    first = needed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).withColumn("crop", crop_box(F.col("box"), width, height))
    return first.select("photo_id", "det_index", "crop", upscale(F.col("crop")).alias("scale"))


def better_reading(before: DataFrame, again: DataFrame) -> DataFrame:
    """(photo_id, det_index, again): whether a document's second reading wins, by its sure characters."""
    a, b = before.select("photo_id", "det_index", F.col("chars").alias("first")), again.select("photo_id", "det_index", F.col("chars").alias("second"))
    return a.join(b, ["photo_id", "det_index"]).withColumn("again", F.col("second") > F.col("first"))


def document_tags(detections: DataFrame, findings: DataFrame) -> DataFrame:
    """(photo_id, finding, document): findings that lie in exactly one document, by its class."""
    docs = detections.where(is_document(F.col("name"))).select("photo_id", "name", F.col("box").alias("b"))
    met = centred(findings.select("photo_id", "finding", F.col("box").alias("a")), docs)
    return met.groupBy("photo_id", "finding").agg(F.count(F.lit(1)).alias("n"), F.first("name").alias("document")).where("n = 1").drop("n")


def unread_plates(plates: DataFrame, findings: DataFrame) -> DataFrame:
    """Plates (photo_id, det_index, box) that no read plate touches."""
    read = findings.where("kind = 'plate'").select("photo_id", F.col("box").alias("b"))
    met = overlapping(plates.withColumnRenamed("box", "a"), read).select("photo_id", "det_index").distinct()
    return plates.join(met, ["photo_id", "det_index"], "left_anti")


def region_findings(detections: DataFrame, spans: DataFrame, findings: DataFrame) -> DataFrame:
    """(photo_id, det_index, kind, certainty, severity, reason): what detected regions tell beside what was read.

    Card numbers first, as a card counts as settled where its number line was found or reported.
    """
    key = ["photo_id", "det_index"]
    boxes = detections.select("photo_id", "det_index", "name", F.col("box").alias("b"))
    found = findings.select("photo_id", "kind", "severity", F.col("box").alias("a"))
    inside = centred(found, boxes)
    has = lambda cond: F.max(F.when(cond, 1).otherwise(0)).alias
    held = inside.groupBy(*key).agg(has(F.col("kind") == "card")("card_in"), has((F.col("severity") != "info") & ~F.col("kind").isin(CODES))("personal"))
    # card number lines: read where a card finding and the line hold each other's centre
    cards = found.where("kind = 'card'")
    lines = boxes.where("name = 'card_number'")
    both = centred(cards, lines).select(*key).union(centred(lines.select("photo_id", "det_index", "b"), cards.drop("kind", "severity"), a="b", b="a").select(*key)).distinct()
    new_lines = lines.join(both, key, "left_anti")
    line_in = centred(new_lines.select("photo_id", F.col("b").alias("a")), boxes.where("name = 'card'")).select(*key).distinct().withColumn("line_in", F.lit(1))
    codes = overlapping(found.where(F.col("kind").isin(CODES)).select("photo_id", "a"), boxes.where("name = 'barcode'"))
    decoded = codes.where(G.share_of_smaller(F.col("a"), F.col("b")) >= 0.3).select(*key).distinct().withColumn("decoded", F.lit(1))
    unread = new_lines.select(*key).withColumn("unread_line", F.lit(1))
    chars = read_in_documents(spans, detections).select(*key, "chars")
    one = boxes
    for other in (held, line_in, decoded, unread, chars):
        one = one.join(other, key, "left")
    name, yes = F.col("name"), lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    blind = is_document(name) & (F.coalesce(F.col("chars"), F.lit(0)) < LEAST_READ)
    report = lambda kind, certainty, severity, reason: F.struct(F.lit(kind).alias("kind"), F.lit(certainty).alias("certainty"), severity.alias("severity"), F.lit(reason).alias("reason"))
    out = (
        F.when(name == "card_number", F.when(yes("unread_line"), report("card", "region", F.lit("cover"), "card_number_region")))
        .when(blind, report("document", "region", F.when(name.isin(COVER_WHEN_UNREAD), "cover").otherwise("review"), "unread"))
        .when(name == "card", F.when(~yes("card_in") & ~yes("line_in"), report("document", "partial", F.lit("cover"), "card_number_unread")))
        .when(name.isin(ALWAYS_PERSONAL) & ~yes("personal"), report("document", "partial", F.lit("review"), "unconfirmed"))
        .when(name == "face_photo", report("face_photo", "region", F.lit("review"), "face_photo"))
        .when((name == "barcode") & ~yes("decoded"), report("barcode", "region", F.lit("review"), "undecoded"))
    )
    return one.select(*key, out.alias("r")).where("r is not null").select(*key, "r.*")


def tiles(width: Column, height: Column, grid: int = 2, overlap: float = 0.2, least_side: int = 1280) -> Column:
    """array<struct<x0,y0,x1,y1>>: overlapping tiles of an image, none for a small one."""
    part = grid - (grid - 1) * overlap

    def along(size: Column, k: int) -> tuple[Column, Column]:
        tile = size / F.lit(part)
        start = F.bround(tile * float(k) * (1 - overlap)).cast("int")
        return start, F.least(size.cast("int"), F.bround(start + tile).cast("int"))

    made = []
    for r in range(grid):
        for c in range(grid):
            (x0, x1), (y0, y1) = along(width, c), along(height, r)
            made.append(F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    none = F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")
    return F.when(F.greatest(width, height) >= least_side, F.array(*made)).otherwise(none) if grid > 1 else none


def cut_by_tile(box: Column, tile: Column, width: Column, height: Column) -> Column:
    """A box in tile pixels touches an edge of the tile that is not the image's own."""
    return (
        ((tile["x0"] > 0) & (box["x"] <= 2))
        | ((tile["y0"] > 0) & (box["y"] <= 2))
        | ((tile["x1"] < width) & (box["x"] + box["w"] >= tile["x1"] - tile["x0"] - 2))
        | ((tile["y1"] < height) & (box["y"] + box["h"] >= tile["y1"] - tile["y0"] - 2))
    )
