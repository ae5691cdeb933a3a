"""A small made-up library with every awkward kind of row."""

import random

import numpy as np

WORDS = ("climate change news daily weekly review global sports digest health wellness science policy journal "
         "education horizons today tonight buzz Klimat Newz Zeitung Größe café élan समाचार पत्रिका новости ＮＥＷＳ").split()


def unit_rows(m):
    m = np.asarray(m, dtype=np.float64)
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(lengths > 0, m / np.where(lengths > 0, lengths, 1), 0).astype(np.float32)


def make(seed, records=140, asked=50, dimension=8, clusters=5, hot=0.35):
    rnd = random.Random(seed)
    gen = np.random.default_rng(seed)
    directions = unit_rows(gen.normal(size=(clusters, dimension)))

    def title():
        r = rnd.random()
        if r < hot:
            return rnd.choice(["Climate News Daily", "climate  news, DAILY!", "समाचार", "पत्रिका समाचार"])
        return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 6)))

    corpus, vectors = [], {}
    near = gen.integers(0, clusters, size=records)
    points = unit_rows(directions[near] + 0.5 * gen.normal(size=(records, dimension)))
    points[:: 9] = points[0]  # many copies of one vector
    for i in range(records):
        corpus.append({
            "id": i + 1, "title": title(), "domain": rnd.choice(["news-sports", "business", "general", "unknown", ""]),
            "language": "English", "description": rnd.choice([None, "about things"]),
            "cluster_id": None if rnd.random() < 0.05 else int(near[i]),
            "record_status": rnd.choice(["active", "active", "approved", "pending", "rejected"]),
        })
        if rnd.random() < 0.95:
            vectors[i + 1] = points[i]
    centroids = [{"cluster_id": c, "centroid": [float(x) for x in directions[c]], "size": int((near == c).sum())}
                 for c in range(clusters)]
    proposals = []
    vec = unit_rows(directions[gen.integers(0, clusters, size=asked)] + 0.6 * gen.normal(size=(asked, dimension)))
    vec[3] = 0.0
    for i in range(asked):
        proposals.append({
            "proposal_id": i + 1, "seq": i + 1,
            "title": "   " if i == 3 else rnd.choice(corpus)["title"] if rnd.random() < 0.3 else title(),
            "domain": rnd.choice(["News - Sports", "business", "general", "", "  "]), "language": "English",
            "description": None, "contact_info": None, "embedding": [float(x) for x in vec[i]],
        })
    return corpus, vectors, centroids, proposals


def frames(spark, data):
    from pyspark.sql import functions as F

    from titlesieve.functions.phonetic import phonetic_code
    from titlesieve.functions.text import normalize_title
    from titlesieve.plans.screen import Library
    from titlesieve.sources import schemas

    corpus, vectors, centroids, proposals = data
    base = spark.createDataFrame(
        corpus, "id long, title string, domain string, language string, description string, cluster_id int, "
                "record_status string")
    table = base.withColumn("normalized_title", normalize_title(F.col("title"))).withColumn(
        "phonetic_code", phonetic_code(F.col("title"), F.col("normalized_title")))
    index = spark.createDataFrame([(i, n, [float(x) for x in v]) for n, (i, v) in enumerate(vectors.items())],
                                  schemas.VECTORS)
    model = spark.createDataFrame(centroids, schemas.CENTROIDS) if centroids else None
    return Library(table.persist(), index.persist(), model), spark.createDataFrame(proposals, schemas.PROPOSALS)
