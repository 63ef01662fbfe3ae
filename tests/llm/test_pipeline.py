"""The pipeline, stage by stage, against brute-force versions of what each stage decides."""

import struct
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from mangrove.llm import queries, secrets, toxicity
from mangrove.llm.common import load

from .test_operators import WORD, brute_spans

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = load(spark, SF, "documents"), [pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
        assert i == 4 or sorted(docs.columns) == sorted(COLUMNS)
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scans", "mixing sources", "packing"]


def test_toxic_documents_go_and_others_stay_as_they_are(spark, stages):
    model = queries.toxicity_model(spark, SF)
    before = {d["doc_id"]: d for d in stages[0]}
    scores = dict(zip(before, model.scores([d["text"] for d in before.values()]), strict=True))
    want = {k for k, s in scores.items() if s < toxicity.THRESHOLD}
    assert {d["doc_id"] for d in stages[1]} == want and all(d == before[d["doc_id"]] for d in stages[1])
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = set(before) - want
    assert gone and sum(labels.get(k) == 0 for k in gone) <= 0.02 * len(labels)


def test_one_document_of_each_class_stays(stages):
    docs = sorted(stages[1], key=lambda d: d["doc_id"])
    words = [d["text"].encode().lower().split() for d in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {docs[i]["doc_id"]: docs[i] for i in range(len(docs)) if find(i) == i}
    assert len(want) < len(docs) and {d["doc_id"]: d for d in stages[2]} == want and len(stages[2]) == len(want)


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = ({d["doc_id"]: d for d in s} for s in (stages[2], stages[3]))
    assert before.keys() == after.keys()
    for key, d in after.items():
        spans = brute_spans(before[key]["text"])
        assert (d == before[key]) or d["n_chars"] == len(d["text"])
        assert not spans or "[SECRET]" in d["text"]
        if not spans and not secrets.candidates(before[key]["text"], []):
            assert d == before[key]
        assert not [s for s in brute_spans(d["text"]) if not s.startswith("assign")]


def test_the_mix_is_what_packing_gets(stages):
    from mangrove.llm.mixing import water_fill

    words = lambda rows: sum((Counter({d["source"]: len(WORD.findall(d["text"]))}) for d in rows), Counter())
    have, got = words(stages[3]), words(stages[4])
    for plan in water_fill(list(have.items())):
        assert abs(got[plan.source] - plan.target) <= 1
    texts = {d["doc_id"]: d["text"] for d in stages[3]}
    copies = Counter(d["doc_id"] for d in stages[4])
    assert max(copies.values()) <= 3
    assert all(d["text"] == texts[d["doc_id"]] or set(WORD.findall(d["text"])) <= set(WORD.findall(texts[d["doc_id"]])) for d in stages[4])


def test_packed_ids_are_those_of_the_mix(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in stages[4]:
        ids = [*plain.encode(d["text"], add_special_tokens=False).ids, 0]
        want[d["doc_id"]] += len(ids)
    got, sums = Counter(), defaultdict(int)
    for r in stages[5]:
        got[r["doc_id"]] += r["length"]
        sums[r["sequence_id"]] += 1
        assert len(struct.unpack(f"<{r['length']}I", r["ids"])) == r["length"]
    assert got == want and set(sums.values()) == {1}


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids").collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], bytes(r["ids"]))
    assert Counter(map(key, rows)) == Counter(map(key, stages[5]))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert name == "packing" or out.columns == table.columns
            out.count()
