"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("conf", T.DoubleType()),
    T.StructField("color", T.StringType()),
])

CONTAINER = T.StructType([
    T.StructField("is_isolated", T.BooleanType()),
    T.StructField("canvas_size", T.StructType([
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
    ])),
])

# One recogniser reply; the three kinds of reply share it, absent members read as NULL.
REPLY = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("container", CONTAINER),
    T.StructField("detail", T.StringType()),
])

RESCAN_REPLY = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("strategy", T.StringType()),
    ]))),
])

DICTIONARY_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("canonicalName", T.StringType()),
    T.StructField("rarity", T.StringType()),
    T.StructField("expertise", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])
