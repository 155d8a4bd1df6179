from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_decontaminate import words
from test_minhash import shingles
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import minhash, quality, surrogates

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{PATH}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = corpus_pipeline.save(stage(spark, docs, PATH))
        out[name] = (given, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages):
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "pii", "tokens"]
    for name, (given, made) in stages.items():
        assert made.columns[:len(given.columns)] == given.columns
        assert len(made.columns) == len(given.columns) + 2 * (name == "tokens")


def test_quality(spark, stages):
    given, made = stages["quality_rules"]
    judged = quality.quality_rules(given, spark.read.parquet(f"{PATH}/labels.parquet"))
    assert texts(made) == texts(judged.where("kept"))
    assert 0 < made.count() < given.count()


def test_one_of_each_group_stays(stages):
    given, made = (texts(df) for df in stages["near_duplicates"])
    sets = {i: shingles(t, 5) for i, t in given.items()}
    links = defaultdict(set)
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    left, seen = {}, set()
    for i in sorted(sets):
        if i not in seen:
            left[i], todo = given[i], [i]
            while todo:
                k = todo.pop()
                seen.add(k)
                todo += links[k] - seen
    assert made == left and len(left) < len(given)


def test_no_benchmark_window_is_left(spark, stages):
    given, made = (texts(df) for df in stages["decontamination"])
    windows = set()
    for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert any(map(hit, given.values()))
    for i, text in given.items():
        assert (made.get(i) == text) != hit(text)


def test_personal_data(stages):
    given, made = (texts(df) for df in stages["pii"])
    replaced = texts(surrogates.replace_pii(stages["pii"][0]))
    assert made == replaced and sum(made[i] != given[i] for i in given) > 0


def test_tokens(stages):
    given, made = stages["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    before = texts(given)
    for r in made.collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.text == before.pop(r.doc_id) and r.n_tokens == len(r.token_ids)
    assert not before


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, PATH)
    assert Counter(map(str, got.collect())) == Counter(map(str, stages["tokens"][1].collect()))


def test_odd_documents(spark, odd, none):
    for docs in (none, odd):
        before = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, PATH)
            if name != "tokens":
                assert docs.columns == before
        assert docs.count() <= 20


def test_rows_alike_leave_one(spark):
    same = "one two three four five six seven"
    rows = [(1, same, "a"), (1, same, "a"), (1, same.upper(), "a"), (1, "other words are here now", "b"),
            (2, same, "c"), (None, same, "d"), (3, "", "e"), (3, "", "e"), (4, None, "f"), (4, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g string")
    got = Counter((r.doc_id, (r.text or "").lower(), r.g) for r in minhash.keep_one(docs).collect())
    assert got == Counter({(None, same, "d"): 1, (1, "other words are here now", "b"): 1,
                           (3, "", "e"): 2, (4, "", "f"): 2})
