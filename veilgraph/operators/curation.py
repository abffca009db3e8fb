"""Dataset rules: box checks, splits by group, samples, file names, annotation joins, status counts, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: smallest box side in pixels, IoU of a box drawn twice, share of the image that a box may cover, target shares
LEAST_PX, TWICE_IOU, WHOLE = 6, 0.9, 0.9
TARGET = {"train": 0.70, "val": 0.15, "test": 0.15}


def drawn_twice(boxes: DataFrame) -> DataFrame:
    """(path, box_no) of boxes at nearly the place (TWICE_IOU) of one of their path and class that has a smaller number.

    Equal boxes are folded first: all but their least number are drawn twice, and that one is held against other boxes.
    Where two overlap by TWICE_IOU, each side is at least that share of the other's, and corners lie no farther apart
    than what is left of the longer side. So a box has one cell, by the powers of two of its sides and by its corner
    in them, and looks in the few cells that a twin can have. Joins are merged: Spark guesses the size of the rows
    spread over cells from the file's, and a broadcast of them takes the driver's memory.
    """
    box, slack = ["path", "class", "x0", "y0", "x1", "y1"], 1e-6
    shown = boxes.where("path is not null and class is not null and box_no is not null and x1 > x0 and y1 > y0")
    first = shown.groupBy(*box).agg(F.min("box_no").alias("first"))
    copies = shown.join(first.hint("merge"), box).where("box_no > first").select("path", "box_no")

    power = lambda side: F.floor(F.log2(side))
    place = lambda at, p: F.floor(at / F.pow(F.lit(2.0), p))
    here, spread = first, first
    for k in ("x", "y"):
        side = F.col(f"{k}1") - F.col(f"{k}0")
        off = side * ((1 / TWICE_IOU - 1) * (1 + slack))
        here = here.withColumn(f"_p{k}", power(side)).withColumn(f"_c{k}", place(F.col(f"{k}0"), F.col(f"_p{k}")))
        spread = spread.withColumn(f"_p{k}", F.explode(F.sequence(power(side * (TWICE_IOU * (1 - slack))), power(side * ((1 + slack) / TWICE_IOU)))))
        spread = spread.withColumn(f"_c{k}", F.explode(F.sequence(place(F.col(f"{k}0") - off, F.col(f"_p{k}")), place(F.col(f"{k}0") + off, F.col(f"_p{k}")))))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    shared = lambda k: F.greatest(F.lit(0), F.least(F.col(f"a.{k}1"), F.col(f"b.{k}1")) - F.greatest(F.col(f"a.{k}0"), F.col(f"b.{k}0")))
    both = shared("x") * shared("y")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("path", "class", "_px", "_py", "_cx", "_cy")]
    twin = (F.col("b.first") < F.col("a.first")) & (both > 0) & (both / (area("a") + area("b") - both) >= TWICE_IOU)
    near = here.alias("a").join(spread.alias("b").hint("merge"), [*same, twin], "left_semi").select("path", F.col("first").alias("box_no"))
    return copies.union(near).distinct()


def box_problems(boxes: DataFrame, face_class: str = "face_photo", card_class: str = "id_card") -> DataFrame:
    """(path, box_no, level, problem) of labelled boxes (path, box_no, class, x0, y0, x1, y1, width, height), in pixels."""
    small = (F.col("x1") - F.col("x0") < LEAST_PX) | (F.col("y1") - F.col("y0") < LEAST_PX)
    whole = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= F.col("width") * F.col("height") * WHOLE
    cx, cy = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    faces, cards = boxes.where(F.col("class") == face_class), boxes.where(F.col("class") == card_class)
    # merged, as in drawn_twice: what Spark guesses from file sizes says little about the cards
    held = [F.col("a.path") == F.col("b.path"), cx.between(F.col("b.x0"), F.col("b.x1")), cy.between(F.col("b.y0"), F.col("b.y1"))]
    outside = faces.alias("a").join(cards.alias("b").hint("merge"), held, "left_anti")
    told = lambda rows, level, problem: rows.select("path", "box_no", F.lit(level).alias("level"), F.lit(problem).alias("problem"))
    out = told(boxes.where(small), "problem", "too small").union(told(drawn_twice(boxes), "problem", "drawn twice"))
    return out.union(told(boxes.where(whole), "warning", "nearly the whole image")).union(told(outside, "warning", "photo outside its card"))


def split_pattern(counts: dict[str, int], n: int) -> list[str]:
    """The splits of the next n new groups: each goes where most is lacking; train, val, test on ties."""
    have, out = {k: counts.get(k, 0) for k in TARGET}, []
    for _ in range(n):
        total = sum(have.values()) + 1
        name = max(TARGET, key=lambda k: round(TARGET[k] * total - have[k], 9))
        have[name] += 1
        out.append(name)
    return out


def group_splits(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(group, split): known groups keep theirs; others, by group name, fill what is lacking; what isn't `real` trains.

    groups: group, source; known: group, split. Once the known shares are made up, the choice repeats every 20
    groups (14, 3 and 3), so the driver works out a bounded pattern and no task sees all groups.
    """
    counts = {r["split"]: r["count"] for r in known.groupBy("split").count().collect()}
    have = sum(counts.values())
    settle = max(0, *(int(counts.get(k, 0) / TARGET[k]) - have + 20 for k in TARGET)) // 20 * 20 + 20
    pattern = split_pattern(counts, min(settle, 1 << 20) + 40)
    head, cycle = pattern[:-20], pattern[-20:]
    fresh = groups.where("source = 'real'").select("group").distinct().join(known.select("group"), "group", "left_anti")
    ranked = ranked_over(fresh, ["group"], "n")
    lit = lambda names: F.array(*map(F.lit, names))
    at = F.when(F.col("n") < len(head), F.get(lit(head), F.col("n").cast("int"))).otherwise(F.get(lit(cycle), ((F.col("n") - len(head)) % 20).cast("int")))
    other = groups.where("source <> 'real'").select("group").distinct().select("group", F.lit("train").alias("split"))
    return known.select("group", "split").unionByName(ranked.select("group", at.alias("split"))).unionByName(other)


def ranked_over(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the row's place, from 0, in the order of all rows, which are range-partitioned: no task holds them all."""
    from veilgraph.plans.ranks import places

    return places(rows, [], order, out)


def first_originals(names: DataFrame, name: str = "name") -> DataFrame:
    """One row (least name) of all augmented copies `<original>.rf.<hash>` of a picture."""
    return names.groupBy(F.element_at(F.split(F.col(name), r"\.rf\."), 1).alias("original")).agg(F.min(name).alias(name))


def every_nth(rows: DataFrame, by: list[str], order: str, step: int) -> DataFrame:
    """Frames 0, step, 2 * step, ... of each group in order."""
    from veilgraph.plans.ranks import places

    return places(rows, by, [order], "_n").where(F.col("_n") % step == 0).drop("_n")


def kept_empty(rows: DataFrame, key: str, boxes: Column, fraction: float) -> DataFrame:
    """All rows with boxes, and a stable share of those without: chosen by a hash of the key."""
    share = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0
    return rows.where((boxes > 0) | (share <= fraction))


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in an order that only the seed and the key decide."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")


def latest_version(names: Column) -> Column:
    """Of names like v12, the one of highest number; others are no versions."""
    number = F.regexp_extract(names, r"^v([0-9]+)$", 1)
    return F.max_by(names, F.when(number != "", F.struct(number.cast("bigint"), names)))


def model_list(models: Column, most: int = 2000) -> Column:
    return F.slice(F.sort_array(F.array_distinct(models)), 1, most)


def located(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): a file of that very name, else one whose name without extension agrees in lower case (least path)."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    stem = lambda c: F.lower(F.regexp_replace(base(c), r"\.[^.]*$", ""))
    exact = files.groupBy(base(F.col("path")).alias("k")).agg(F.max("path").alias("exact"))
    loose = files.groupBy(stem(F.col("path")).alias("s")).agg(F.min("path").alias("loose"))
    asked = wanted.select("name", base(F.col("name")).alias("k"), stem(F.col("name")).alias("s"))
    return asked.join(exact, "k", "left").join(loose, "s", "left").select("name", F.coalesce("exact", "loose").alias("path"))


def annotated(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(image_id, file_name, boxes): every image with its boxes of known classes; images without any keep an empty list."""
    known = annotations.join(classes, "category_id").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("annotation_id", "class"))).alias("boxes"))
    none = F.array().cast(known.schema["boxes"].dataType)
    return images.join(known, "image_id", "left").withColumn("boxes", F.coalesce("boxes", none))


def skipped_names(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """(category_id, n): annotations of categories that have no class."""
    return annotations.join(classes.select("category_id"), "category_id", "left_anti").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def class_of(name: Column, rules: list[tuple[str, str]], skip: str) -> Column:
    """The class of the first pattern that the name holds; null for names that the skip pattern holds, or none does."""
    low = F.lower(name)
    out = F.when(low.rlike(skip), F.lit(None).cast("string"))
    for pattern, label in rules:
        out = out.when(low.rlike(pattern), label)
    return out


def status_counts(manifest: DataFrame) -> DataFrame:
    """(split, source, rows, groups) of finished rows, with each split's total over all sources (source null)."""
    done = manifest.where("status = 'done'")
    out = done.rollup("split", "source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("group").alias("groups"), F.grouping("split").alias("_s"))
    return out.where("_s = 0").drop("_s")


def promoted(better: Column, n_val: Column, n_test: Column, has_current: Column, force: Column) -> tuple[Column, Column]:
    """(whether the new model replaces the old one, whether lack of real validation blocks it)."""
    blocked = (n_val == 0) & (n_test == 0) & has_current
    return (better & ~blocked) | force, blocked & ~force


def picture_file(name: Column) -> Column:
    """A picture by its extension, and not a hidden file."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.lower(base).rlike(r"\.(jpe?g|png|webp|bmp)$") & ~base.startswith(".")


def rotated_label(box: Column, angle: int) -> Column:
    """A box of shares of the image (cx, cy, w, h), after the image has been turned clockwise by 90, 180 or 270 degrees."""
    cx, cy = {90: (1 - box["cy"], box["cx"]), 180: (1 - box["cx"], 1 - box["cy"]), 270: (box["cy"], 1 - box["cx"])}[angle]
    w, h = (box["w"], box["h"]) if angle == 180 else (box["h"], box["w"])
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
