"""Small document tables with the awkward cases."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.7) for _ in range(n))


def documents(spark, rows, extra=False):
    """rows: (doc_id, text); extra adds columns whose names clash with those used inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "t", "n", "key", "held", "host", "component_id", "score", "kept", "_t", "_text", "_w", "size", "x", "k"):
            df = df.withColumn(name, F.lit("clash"))
    return df


AWKWARD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, prose(1, 60)), (5, prose(1, 60)), (6, prose(2, 4000)), (7, "Ünïcödé \U0001f600 text here"), (8, "one"), (9, prose(3, 70)), (9, prose(3, 70))]
