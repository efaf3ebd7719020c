"""The pipeline's result holds the ids of the texts it packed."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np


def test_the_pipelines_pieces_make_up_the_drawn_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from annulus.llm import poisson_mix, queries

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(31)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)), "a") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    copies = {r.doc_id: r["count"] for r in poisson_mix.mix(frame).groupBy("doc_id").count().collect()}
    got = defaultdict(Counter)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id].update(enumerate(ids, r.start))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}
    assert got == {i: Counter({x: n for x in enumerate(want[i])}) for i, n in copies.items()}
