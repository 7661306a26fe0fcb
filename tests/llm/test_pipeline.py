import hashlib
import re
import time

import corpus_pipeline
import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from passagekit.llm import mixing, sentencepiece_codec, toxicity
from passagekit.llm.common import cut, documents, read

from .test_jaccard import plain_groups
from .test_text import plain_model

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_mix(rows):
    """Texts of the mix by the rule: budgets down the tree, documents in order of their key, the last one cut."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = {}
    for doc, text, lang, source in rows:
        number = re.search("[0-9]+$", source or "")
        domain = str(int(number[0]) % 4) if number else "unknown"
        leaves.setdefault((domain, lang or "unknown", source or "unknown"), []).append((doc, text))
    words = {leaf: sum(count(t) for _, t in docs) for leaf, docs in leaves.items()}

    def shared(names, caps, weights, budget):
        order = sorted(names, key=lambda n: (caps[n] / weights[n], n))
        got, left, weight = {}, budget, sum(weights.values())
        for k, n in enumerate(order):
            if caps[n] * weight <= weights[n] * left:
                got[n], left, weight = caps[n], left - caps[n], weight - weights[n]
            else:
                return got | {m: weights[m] * left // weight for m in order[k:]}
        return got

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        names = sorted({leaf[depth] for leaf in leaves if leaf[:depth] == prefix})
        caps = {n: mixing.EPOCHS * sum(w for leaf, w in words.items() if leaf[: depth + 1] == (*prefix, n)) for n in names}
        table = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})[depth]
        out = {}
        for n, got in shared(names, caps, {n: table.get(n, 1) for n in names}, budget).items():
            out |= down((*prefix, n), got)
        return out

    taken = []
    for leaf, budget in down((), int(sum(words.values()) * mixing.TOTAL)).items():
        if not words[leaf]:
            continue
        passes, need = divmod(budget, words[leaf])
        key = lambda d: hashlib.md5(f"{mixing.SEED}:{passes}:{d[0]}".encode()).hexdigest()
        for doc, text in sorted(leaves[leaf], key=key):
            taken += [(doc, text)] * passes
            if need > 0:
                n = count(text)
                ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
                taken.append((doc, text if n <= need else text[: ends[need - 1]]))
                need -= n
    return taken


def test_stages_against_plain_versions(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    rows = docs.collect()
    about = {r.doc_id: (r.lang, r.source) for r in rows}
    texts = {r.doc_id: r.text or "" for r in rows}
    stages = dict(corpus_pipeline.STAGES)

    labels = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    score = plain_model(texts, labels)
    docs = cut(stages["toxicity"](spark, docs, SF), "t1")
    kept = {i: t for i, t in texts.items() if score(t) < 0.5}
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(kept) and len(kept) < len(texts)

    docs = cut(stages["exact dedup"](spark, docs, SF), "t2")
    last = {t.translate(LOWER): i for i, t in sorted(kept.items())}
    kept = {i: kept[i] for i in last.values()}
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(kept)

    docs = cut(stages["near dedup"](spark, docs, SF), "t3")
    ids = sorted(kept)
    kept = {ids[k]: kept[ids[k]] for k in set(plain_groups([kept[i] for i in ids]))}
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(kept)

    docs = cut(stages["mixing"](spark, docs, SF), "t4")
    want = plain_mix([(i, t, *about[i]) for i, t in kept.items()])
    got = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert docs.columns == columns and sorted(got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text and r.text != texts[r.doc_id])

    whole = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    coded = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["sentencepiece"](spark, docs, SF).collect())
    plain = []
    for i, t in want:
        ids = whole.encode(t, add_bos=True, add_eos=True)
        plain.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids).encode()).hexdigest()))
    assert coded == sorted(plain)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null texts, extra columns of inner names, and empty tables go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, _row string, place string, node string, copies string"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "same text", "en"), (1, "another text of the same id", "en"), (5, "SAME text", None), (None, "same text", "de"), (None, long, "en"), (7, long + " end", "en"), (8, None, None), (9, "", "fr"), (7, long + " end", "en")]
    docs = spark.createDataFrame([(i, t, lang, "src1" if lang else None, 3, "r", "p", "n", "c") for i, t, lang in rows], schema.replace("_row", "line"))
    spark.createDataFrame([(1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        docs = cut(stage(spark, docs, str(tmp_path)), "odd")
        assert none.count() == 0 and none.columns == docs.columns
        sizes[name] = sorted(str(r.doc_id) for r in docs.collect())
    assert sizes["toxicity"] == sorted(str(i) for i, *_ in rows)
    assert sizes["exact dedup"] == sorted(["1", "5", "None", "7", "9"])
    assert sizes["near dedup"] == sorted(["1", "5", "7", "9"])
    assert set(sizes["mixing"]) <= set(sizes["near dedup"]) and docs.count() == len(sizes["mixing"])


def test_no_shuffle_files_stay_behind_a_table(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: manager.getAllFiles().mkString("\n").count("/shuffle_")
    before = files()
    table = cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counted")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 10
