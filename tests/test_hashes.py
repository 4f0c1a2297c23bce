import random

from pyspark.sql import functions as F

from tidewire.functions import binary, text


def test_many_values_as_one_by_one():
    r = random.Random(3)
    values = [None, b"", *(r.randbytes(r.randint(0, 40)) for _ in range(300))]
    for seed in (0, 7, 2**32 - 1):
        assert binary.murmur3_32_many(values, seed) == [None if v is None else binary.murmur3_32(v, seed) for v in values]
        assert binary.murmur2_64_many(values, seed) == [None if v is None else binary.murmur2_64(v, seed) for v in values]
    words = [r.choice(["a", "pass word", "é", "", None]) for _ in values]
    hidden = binary.zip_cipher_many(values, words, decrypt=False)
    assert hidden == [None if v is None or w is None else binary.ZipCipher(w.encode()).encrypt(v) for v, w in zip(values, words)]
    assert binary.zip_cipher_many(hidden, words, decrypt=True) == [None if w is None else v for v, w in zip(values, words)]


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, "abc", 1.5), (2, None, None), (3, "", float("-inf")), (4, "x" * 5000, 1e300)], "id int, s string, x double")
    rows = df.select("id", binary.murmur3_32_col("s").alias("h"), binary.murmur2_64_col("s").alias("g"), binary.encrypt_col(F.encode("s", "UTF-8"), F.lit("k")).alias("e"),
                     *(text.floating(binary.floating_bytes(F.col("x"), n, big), 0, n, big).alias(f"x{n}{big}") for n in (4, 8) for big in (True, False))).orderBy("id").collect()
    assert [r.h for r in rows] == [binary.murmur3_32(b"abc"), None, 0, binary.murmur3_32(b"x" * 5000)]
    assert rows[1].g is None and rows[1].e is None and bytes(rows[2].e) == b"" and len(rows[3].e) == 5000
    for n in (4, 8):
        for big in (True, False):
            assert [r[f"x{n}{big}"] for r in rows] == [1.5, None, float("-inf"), float("inf") if n == 4 else 1e300]
