import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, simhash, toxicity
from docloom.llm.common import table

from .helpers import ODD, documents
from .test_decontaminate import brute as overlaps
from .test_simhash import jaccard, shingles
from .test_substrings import brute as repeated

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0], str(r)))


def test_stages_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    clean = stages["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    every = rows(docs)
    assert clean.columns == docs.columns
    assert rows(clean) == [r for r, s in zip(every, model.score([r[1] for r in every])) if s < toxicity.THRESHOLD]
    one = rows(stages["simhash_near_dedup"](spark, docs, SF))
    sets, gone = {r[0]: shingles(r[1]) for r in every}, {r[0] for r in every} - {r[0] for r in one}
    assert one == [r for r in every if r[0] not in gone] and gone
    for i in gone:  # each that leaves is like one with a smaller doc_id; of exact copies all but one leave
        assert any(jaccard(sets[i], sets[j]) > 0.7 or not (sets[i] or sets[j]) for j in sets if j < i)
    firsts = {}
    for r in every:
        firsts.setdefault(" ".join((r[1] or "").lower().split()), r[0])
    assert {r[0] for r in every} - set(firsts.values()) <= gone
    pairs = [(i, j) for i in sets for j in sets if j < i and sets[i] != sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(i in gone for i, _ in pairs) >= 0.9 * len(pairs)
    rest = stages["substring_dedup"](spark, docs, SF)
    assert rest.dtypes == docs.dtypes
    for old, new, (_, n, gone, digest) in zip(every, rows(rest), repeated((r[0], r[1]) for r in every)):
        assert (old[0], old[2], old[3]) == (new[0], new[2], new[3]) and new[4] == len(new[1])
        assert old == new if not gone else hashlib.sha256(new[1].encode()).hexdigest() == digest
    few = docs.where("n_chars < 2500")
    left = stages["benchmark_decontamination"](spark, few, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = overlaps([(r[0], r[1]) for r in rows(few)], items)
    assert rows(left) == [r for r in rows(few) if r[0] not in bad] and bad


def test_run_encodes_what_the_stages_leave(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    enc = bpe.encoder(bpe.RANKS, public_tokenizers.PATTERN)
    want = []
    for r in rows(docs):
        ids = np.array(enc.encode_ordinary(r[1]), "<u4")
        want.append((r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
    assert rows(corpus_pipeline.run(spark, SF)) == want and want


def test_odd_rows_and_empty_table(spark):
    odd = documents(spark, ODD)
    odd = odd.unionByName(odd.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).toDF("doc_id", "text", "lang", "toxic_flag", "n_chars", "a.b c")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            assert stage is corpus_pipeline.encode or docs.dtypes == before.dtypes
        assert docs.count() <= len(ODD) + 3
    odd = documents(spark, ODD)
    assert simhash.cluster(odd).count() == len(ODD)
