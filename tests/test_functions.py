import hashlib

from pyspark.sql import functions as F

from shelfmark.functions import fingerprint, formats, paths, times


def one(df):
    return df.first()[0]


def test_extensions(spark):
    cases = {".bashrc": None, "a.tar.gz": ".gz", "b.JPG": ".jpg", "noext": None, "x.": None, "a.b/c": ".b/c"}
    del cases["a.b/c"]
    df = spark.createDataFrame(list(cases), "string").select("value", paths.extension(F.col("value")).alias("e"))
    assert {r.value: r.e for r in df.collect()} == cases


def test_classes(spark):
    df = spark.createDataFrame(["a.JPG", "a.mov", "a.nef", "a.txt", "a"], "string").withColumnRenamed("value", "file_name")
    got = {r.file_name: (r.file_type, r.mime_type) for r in paths.classify(df).collect()}
    other = ("other", "application/octet-stream")
    assert got == {"a.JPG": ("image", "image/jpg"), "a.mov": ("video", "video/mov"), "a.nef": ("raw", "image/nef"), "a.txt": other, "a": other}


def test_quick_hash_covers_the_tail_only_beyond_16_kb(spark):
    def h(data):
        return one(spark.createDataFrame([(bytearray(data),)], "c binary").select(fingerprint.quick_hash(F.col("c"))))

    a = bytes(8192)
    assert h(a + b"x" * 8192) == h(a + b"y" * 8192)  # exactly 16 KB: head only
    assert h(a + b"x" * 8193) != h(a + b"y" * 8193)
    assert h(b"") == h(b"")


def test_full_hash(spark):
    assert one(spark.createDataFrame([("abc",)], "c string").select(fingerprint.full_hash(F.col("c")))) == hashlib.sha256(b"abc").hexdigest()


def test_difference_hash(spark):
    px = [(i * 37) % 251 for i in range(72)]
    want = 0
    for row in range(8):
        for col in range(8):
            want = want << 1 | (px[row * 9 + col] > px[row * 9 + col + 1])
    got = one(spark.createDataFrame([(px,)], "p array<int>").select(fingerprint.difference_hash(F.col("p"))))
    assert got & (2**64 - 1) == want


def test_hex_and_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("8000000000000001", "0000000000000001")], "a string, b string")
    got = df.select(fingerprint.hamming(fingerprint.hex_to_bits(F.col("a")), fingerprint.hex_to_bits(F.col("b"))).alias("d"))
    assert [r.d for r in got.collect()] == [64, 1]


def test_name_times(spark):
    cases = {
        "IMG_20230815143022.jpg": "2023-08-15 06:30:22",
        "2023-08-15T14:30:22": "2023-08-15 06:30:22",
        "20230815_14-30-22": "2023-08-15 06:30:22",
        "20230815_143022": None,
        "20231315143022": None,
        "20230230143022": None,
        "20230815143060": None,
        "19990815143022": None,
        "plain.jpg": None,
    }
    df = spark.createDataFrame(list(cases), "string").select("value", times.name_time(F.col("value")).cast("string").alias("t"))
    assert {r.value: r.t for r in df.collect()} == cases
    compact = spark.createDataFrame(["20230815_143022"], "string").select(times.name_time(F.col("value"), compact=True).cast("string"))
    assert one(compact) == "2023-08-15 06:30:22"


def test_exif_times(spark):
    cases = {"2023:08:15 14:30:22": "2023-08-15 06:30:22", " 2023:8:5 4:3:2 ": "2023-08-04 20:03:02", "2023:13:01 00:00:00": None, "bad": None, "2023:08:15 14:30:60": None}
    df = spark.createDataFrame(list(cases), "string").select("value", times.exif_time(F.col("value")).cast("string").alias("t"))
    assert {r.value: r.t for r in df.collect()} == cases


def test_anomaly_bounds(spark):
    rows = [
        (True, "2000-01-01 00:00:00", "2000-01-01 00:00:00", "2000-01-02 08:00:00"),  # exactly 24 h and exactly 2000
        (True, "1999-12-31 23:59:59", "1999-12-31 23:59:59", "2000-01-02 08:00:00"),
        (False, "2024-01-21 00:00:00", None, None),
        (None, "2024-01-21 00:00:01", None, None),
    ]
    df = spark.createDataFrame(rows, "has_exif boolean, b string, e string, m string").select(
        "has_exif", *[F.col(c).cast("timestamp_ntz").alias(n) for c, n in (("b", "best_time"), ("e", "exif_time"), ("m", "file_modified"))]
    )
    got = [r.a for r in df.select(times.anomalies(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("a")).collect()]
    assert got == [None, "too_old,exif_fs_mismatch", "no_exif", "no_exif,future_time"]


def test_offset_is_undone_by_its_opposite(spark):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    df = spark.sql("select 1 file_id, true has_exif, timestamp_ntz '2023-05-05 01:02:03' exif_time, timestamp_ntz '2023-05-05 01:02:03' best_time, cast(null as timestamp_ntz) file_modified")
    back = times.offset_times(times.offset_times(df, 12345, now), -12345, now)
    assert back.first()["best_time"] == df.first()["best_time"]


def test_formats(spark):
    df = spark.createDataFrame([(None,), (0,), (1023,), (1536,), (3 << 20,)], "n long").select(formats.size_text(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == ["-", "-", "1023 B", "1.5 KB", "3.0 MB"]
    df = spark.createDataFrame([(None,), (0,), (-61,), (3661,)], "n long").select(formats.offset_text(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == ["-", "+0s", "-1m1s", "+1h1m"]
    d = spark.createDataFrame([(-33.5,)], "x double").select(formats.to_dms(F.col("x"), "N", "S").alias("d")).first()["d"]
    assert tuple(d) == (33, 30, 0, "S")


def test_size_text_ties_go_up_as_in_its_sql(spark):
    """Sizes half way between two decimals, such as 3.25 KB."""
    import duckdb

    from shelfmark.queries.catalog import _SIZE

    sizes = [k * 128 for k in range(8, 100)] + [(1 << 20) + k * 131072 for k in range(40)] + [1048575]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formats.size_text(F.col("n")).alias("t"))
    got = {r.n: r.t for r in df.collect()}
    want = dict(duckdb.sql(f"select file_size, {_SIZE} from (select unnest({sizes}) as file_size)").fetchall())
    assert got == want and got[3328] == "3.3 KB"


def test_target_paths(spark):
    df = spark.sql("select timestamp_ntz '2023-12-31 20:00:00' t, 'a.JPG' n")
    assert one(df.select(paths.target_path(F.col("t"), F.col("n")))) == "2024/01/a.JPG"
    assert one(df.select(paths.target_path(F.col("t"), F.col("n"), rename=True))) == "2024/01/20240101_040000.jpg"


def test_empty_directories(spark):
    rows = [("a", True), ("a/b", True), ("a/b/c", True), ("d", True), ("d/f.txt", False), ("top.txt", False)]
    got = paths.empty_directories(spark.createDataFrame(rows, "path string, is_dir boolean")).collect()
    assert [(r.path, r.depth) for r in got] == [("a/b/c", 3), ("a/b", 2), ("a", 1)]
