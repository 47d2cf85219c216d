"""Records put together by several tasks a file, against files read whole."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from terrapulse.schemas import PERMIT_COLUMNS
from terrapulse.sources import permits
from terrapulse.sources.records import records


def landed(path, seed, n):
    rng = random.Random(seed)
    values = ["a", "", "***", '"x;y"', '"one\ntwo"', '"three\n\n\nfour;""q"""', '"a\r\nb"', "João", '""', "  s ", '"1\n2\n3\n4\n5"']
    lines = [";".join(PERMIT_COLUMNS)]
    for i in range(n):
        lines.append(";".join([str(i)] + [rng.choice(values) for _ in PERMIT_COLUMNS[1:]]) + rng.choice(["", "", ";too;many"]))
        if rng.random() < 0.05:
            lines.append("")
    path.write_bytes("\n".join(lines).encode("latin-1") + b"\n")


def rows(df):
    return sorted((tuple(r) for r in df.drop("position").collect()), key=str)


def test_same_rows_as_whole_files(spark, tmp_path):
    """Quoted breaks that lie across the borders of ranges, in files of one range and of many; every file by several tasks."""
    for month, n in (("2026-01", 900), ("2026-02", 3), ("2026-03", 400)):
        landed(tmp_path / f"{month}-01_Alvaras_-_Base_de_Dados.csv", month, n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    paths = sorted(str(p) for p in tmp_path.iterdir())
    whole = rows(permits._scan(spark, PERMIT_COLUMNS, paths, multi_line=True))
    assert len(whole) == 1303
    for size in ("1kb", "7kb", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        try:
            assert rows(permits.read_permits(spark, str(tmp_path), every_snapshot=True)) == whole
            if size == "1kb":
                used = spark.read.text(paths).select("_metadata.file_path", "_metadata.file_block_start").distinct().groupBy("file_path").count()
                assert max(r["count"] for r in used.collect()) > 20
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_first_lines_keep_their_order(spark, tmp_path):
    path = tmp_path / "2026-01-01_Alvaras_-_Base_de_Dados.csv"
    landed(path, 5, 200)
    read = permits.read_permits(spark, str(tmp_path))
    assert [r["NOME_EMPRESARIAL"] for r in read.orderBy("position").collect()] == [str(i) for i in range(200)]


def test_unclosed_and_empty(spark, tmp_path):
    """A field that is never closed takes the rest of its file, and only of its file."""
    (tmp_path / "a").write_text('h\none\n"two\nthree\nfour')
    (tmp_path / "b").write_text('x\r\n"y\r\nz"\r\n\r\n')
    (tmp_path / "c").write_text("")
    found = records(spark, [str(tmp_path)]).select(F.element_at(F.split("path", "/"), -1).alias("f"), "line", "record")
    assert sorted(map(tuple, found.collect())) == [("a", 0, "h"), ("a", 1, "one"), ("a", 2, '"two\nthree\nfour'), ("b", 0, "x"), ("b", 1, '"y\r\nz"')]
