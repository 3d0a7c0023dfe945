"""Rejection of what lies outside the learned languages, on held-out documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popshift.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(DOCS).where("lang is not null and text is not null").persist()


def judged(docs, model):
    return [r["rejected"] for r in langid.identify(docs, model).collect()]


@pytest.mark.parametrize("left_out", [None, "de", "en", "es", "fr"])
def test_foreign_texts_are_rejected_and_own_ones_kept(table, left_out):
    docs = table if left_out is None else table.where(F.col("lang") != left_out)
    model = langid.fit(docs)
    held = table.where(langid.fold(F.col("doc_id")) == 0)
    own = held if left_out is None else held.where(F.col("lang") != left_out)
    lost = judged(own, model)
    assert sum(lost) <= max(1, 0.01 * len(lost))
    texts = [r["text"] for r in own.select("text").collect()]
    rng = np.random.default_rng(3)
    for change in (langid._shuffled, langid._written_over):
        foreign = table.sparkSession.createDataFrame([(k, change(t, rng)) for k, t in enumerate(texts) if len(t) >= 40], "doc_id long, text string")
        rejected = judged(foreign, model)
        assert sum(rejected) >= 0.9 * len(rejected), change.__name__
    if left_out:
        rejected = judged(held.where(F.col("lang") == left_out), model)
        assert sum(rejected) >= 0.9 * len(rejected)


def test_texts_of_other_languages_and_code(table):
    model = langid.fit(table)
    for text in (
        "今天天气很好我们一起去公园散步吧这是一个测试文本用来检测语言识别", "Сегодня хорошая погода и мы идём гулять в парк вместе с друзьями",
        "Tänään on kaunis sää ja menemme puistoon kävelylle ystävien kanssa, koska haluamme nauttia auringosta", "xqzv kjwp qqlx zzvb wkqj pxvz jqkw vvxq bzkj",
        "int main(int argc, char **argv) { for (int i = 0; i < argc; i++) printf(\"%s\\n\", argv[i]); return 0; }", "Dzisiaj jest piękna pogoda i idziemy do parku na spacer z przyjaciółmi",
    ):
        lang, score, rejected = model.judge(text)
        assert rejected, (text, lang, score)
    assert 0 < model.temperature and 0.1 < model.temperature < 100


def test_calibration_of_one_language_and_of_overlapping_texts():
    rng = np.random.default_rng(1)
    sample = lambda lang, lo: (lang, u := np.unique(rng.integers(lo, lo + 300, 60)), np.full(len(u), 1 / len(u), np.float32))
    one = langid.train([sample("a", 0) for _ in range(40)])
    assert one.langs == ["a"] and one.judge("some text")[0] == "a" and one.judge(None) == ("und", 0.0, True)
    both = [sample(x, k * 1000) for k, x in enumerate("ab") for _ in range(80)]
    apart = langid.train(both, [sample("a", 5000) for _ in range(30)])
    same = langid.train(both, [sample("a", 0) for _ in range(30)])  # foreign texts that look like own ones: own ones stay
    own = langid.evidence(langid._logits(apart, both))
    assert (own < apart.threshold).mean() <= 0.01 and (langid.evidence(langid._logits(same, both)) < same.threshold).mean() <= 0.02
