"""Packed documents: whole round trip, reading by name, and which containers are read."""

from gleaner.session import new_folder
from gleaner.sources.packed import read_packed, write_packed
from gleaner.sources.sinks import read_text_documents, write_text_documents

ROWS = [
    ("a", "one\ntwo\n"), ("b", ""), ("c", None), (None, "no name"), ("d", "Zürich — ünï 漢字 🎈\r\n\n"), ("e", "same"), ("e", "same"),
    ("e", "other"), ("long", "wörter " * 40_000), ("f/g=h", "\n"),
]


def packed(spark, rows, **options):
    path = new_folder(spark, "packed")
    write_packed(spark.createDataFrame(rows, "table_name string, text string"), path, **options)
    return path


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_round_trip_of_odd_texts(spark):
    for size in (64, 1 << 20):
        assert as_rows(read_packed(spark, packed(spark, ROWS, container_bytes=size))) == sorted(ROWS, key=repr)
    assert read_packed(spark, packed(spark, [])).count() == 0


def test_read_by_name(spark):
    path = packed(spark, ROWS, container_bytes=64)
    names = spark.createDataFrame([("e",), ("d",), ("d",), (None,), ("unknown",)], "table_name string")
    assert as_rows(read_packed(spark, path, names)) == sorted([r for r in ROWS if r[0] in ("d", "e", None)], key=repr)


def test_number_of_files_follows_the_bytes_and_few_are_read(spark):
    rows = [(f"t{i}", f"text {i} " * 20) for i in range(1000)]
    path = packed(spark, rows, container_bytes=20_000)
    files = spark.read.text(f"{path}/containers", wholetext=True).inputFiles()
    assert 5 < len(files) <= 12
    one = read_packed(spark, path, spark.createDataFrame([("t7",)], "table_name string"))
    assert as_rows(one) == [rows[7]]
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in next(x for x in text.splitlines() if "FileScan text" in x)


def test_a_folder_per_table(spark):
    path = new_folder(spark, "folders")
    rows = [("a", "one\ntwo\n"), ("b", "x")]
    write_text_documents(spark.createDataFrame(rows, "table_name string, text string"), path)
    assert as_rows(read_text_documents(spark, path)) == rows
