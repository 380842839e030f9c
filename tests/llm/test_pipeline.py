from __future__ import annotations

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from test_decontaminate import brute as brute_hits
from test_repeats import brute as brute_repeats
from test_simhash import brute_components, brute_fingerprint
from touchline.llm import byte_bpe, rules
from touchline.llm.frames import table


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_equals_brute_force_on_its_input(spark, small):
    docs = table(spark, small, "documents")
    steps = dict(corpus_pipeline.STAGES)
    given = by_id(docs)

    good = steps["quality rules"](spark, docs, small)
    assert good.columns == docs.columns
    judged = rules.judged(docs, table(spark, small, "labels"))
    kept = {r.doc for r in judged.where("kept").collect()}
    found = by_id(good)
    assert found.keys() == kept and all(found[i] == given[i] for i in kept)

    single = steps["SimHash near-dedup"](spark, good, small)
    ids = sorted(kept)
    groups = brute_components(ids, [brute_fingerprint(given[i].text) for i in ids], 2)
    kept = {i for i in ids if groups[i] == i}
    found = by_id(single)
    assert found.keys() == kept and all(found[i] == given[i] for i in kept)

    cut = steps["suffix-array dedup"](spark, single, small)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    found = by_id(cut)
    ids = sorted(kept)
    for i, (_, _, _, left) in zip(ids, brute_repeats([(i, given[i].text) for i in ids])):
        assert found[i].text == left.decode(errors="ignore")
        assert found[i].n_chars == len(found[i].text)
        assert (found[i].lang, found[i].source) == (given[i].lang, given[i].source)
    assert found.keys() == kept

    clean = steps["benchmark decontamination"](spark, cut, small)
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    hits = brute_hits([(i, found[i].text) for i in ids], items, 13)
    kept = {i for i, words, hit, _ in hits if not (hit and 20 * hit >= words)}
    assert by_id(clean).keys() == kept

    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)),
        special_tokens={},
    )
    done = by_id(steps["byte-level BPE"](spark, clean, small))
    assert done.keys() == kept
    for i in kept:
        assert done[i].n_tokens == len(library.encode_ordinary(found[i].text))
        assert done[i].decoded_sha256 == hashlib.sha256(found[i].text.encode()).hexdigest()

    whole = by_id(corpus_pipeline.run(spark, small))
    assert whole == done


def test_empty_documents(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, small, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
