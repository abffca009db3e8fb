"""Readers: tables, manifests, gold and annotation JSON, label lines, binary images behind a pluggable backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "struct<checked:boolean,items:array<struct<text:string,expect:string,item:string>>>"
MANIFEST = ["id", "group", "source", "split", "status", "added_at", "orig_name", "prelabel"]
SPANS = "photo_id string, span_index int, text string, box struct<x:int,y:int,w:int,h:int>, conf double"
Backend = Callable[[bytes], list[tuple[str, int, int, int, int, float]]]
_BACKENDS: dict[str, Backend] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, perhaps behind a byte-order mark; columns that are missing read as empty."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in MANIFEST))


def gold(rows: DataFrame, photo: str = "photo", body: str = "body") -> DataFrame:
    """(photo, gold_index, text, expect, item): files marked unchecked are left out, and empty ones unless marked checked."""
    parsed = rows.select(F.col(photo).alias("photo"), F.from_json(body, GOLD).alias("g")).where("g is not null and coalesce(g.checked, true)")
    return parsed.select("photo", F.posexplode("g.items").alias("gold_index", "i")).select("photo", "gold_index", "i.*")


def coco(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(file_name, category, x, y, w, h) of annotations whose image and category are known."""
    named = annotations.join(images, annotations["image_id"] == images["id"]).select("file_name", "category_id", "bbox")
    return named.join(categories, named["category_id"] == categories["id"]).select("file_name", F.col("name").alias("category"), *(F.element_at("bbox", i + 1).alias(c) for i, c in enumerate("xywh")))


def register_backend(name: str, read: Backend) -> None:
    """read(image bytes) -> [(text, x, y, w, h, conf)]; one process holds one backend, built where it runs."""
    _BACKENDS[name] = read


def spans_of_images(images: DataFrame, read: Backend | str) -> DataFrame:
    """binaryFile rows -> spans, dropping blank text and negative confidence; an unreadable image gives none.

    `read` is a backend or the name under which one was registered."""
    read = _BACKENDS[read] if isinstance(read, str) else read

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = read(bytes(content))
                except ValueError:
                    found = []
                kept = [f for f in found if f[0].strip() and f[5] >= 0]
                out += [(path, i, t, {"x": x, "y": y, "w": w, "h": h}, c) for i, (t, x, y, w, h, c) in enumerate(kept)]
            yield pd.DataFrame(out, columns=["photo_id", "span_index", "text", "box", "conf"])

    return images.select("path", "content").mapInPandas(run, SPANS)
