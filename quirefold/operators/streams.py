"""Reading chosen streams of decks, and writing decks anew by parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import filters


def selected_streams(streams: DataFrame, wanted: DataFrame, level: str = "generalized") -> tuple[DataFrame, DataFrame]:
    """(deck_id, ref, bytes, filters, damaged) of the streams that are wanted, and (deck_id, filter, streams): how many streams of a deck keep which filter.

    streams: deck_id, ref, content, filters, parms (as ``filters.PARMS``); wanted: deck_id, ref, repeats allowed. Only streams that are listed reach Python.
    """
    asked = wanted.select("deck_id", "ref").distinct()
    read = streams.join(asked, ["deck_id", "ref"], "left_semi").select("deck_id", "ref", filters.decoded(F.col("content"), F.col("filters"), F.col("parms"), level).alias("d"))
    read = read.select("deck_id", "ref", "d.bytes", "d.filters", "d.damaged")
    stay = read.select("deck_id", "ref", F.explode("filters").alias("filter")).distinct().groupBy("deck_id", "filter").agg(F.count("*").alias("streams"))
    return read, stay
