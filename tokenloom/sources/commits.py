"""Small numbered records beside a table: which parts of it count, and how far a job has come.

A record is one line of JSON in ``<table>/_commits/<number>``, a folder that
Spark's readers skip.  It is written in full under another name and then renamed,
so a reader sees all of it or nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_commits"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_record(spark: SparkSession, table: str, number: int, record: dict, replace: bool = False) -> bool:
    """Store ``record`` under ``number``; False if the number is taken, unless ``replace``."""
    fs, final = _fs(spark, f"{table}/{FOLDER}/{int(number):012d}")
    _, staged = _fs(spark, f"{table}/{FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(staged)
    try:
        out.write(bytearray(json.dumps(record).encode()))
    finally:
        out.close()
    if replace and fs.exists(final):
        fs.delete(final, False)
    if not fs.exists(final) and fs.rename(staged, final):
        return True
    fs.delete(staged, False)
    return False


def last_number(spark: SparkSession, table: str) -> int:
    """The highest number with a record; -1 without any."""
    fs, folder = _fs(spark, f"{table}/{FOLDER}")
    if not fs.exists(folder):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def get_record(spark: SparkSession, table: str, number: int) -> dict | None:
    fs, p = _fs(spark, f"{table}/{FOLDER}/{int(number):012d}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
