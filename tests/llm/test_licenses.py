import re

from demandgauge.llm import licenses
from demandgauge.llm.queries import QUERIES


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')"


def test_bases_and_templates(spark):
    texts = [None, "", "...", "MIT License", "cc by cc by-CC/BY", "gnu general public\nlicense! Apache License", "the mit licenses", "license",
             f"say the\n{NOTICE} and more", NOTICE.replace("hereby granted", "granted"), "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "word " * 9000 + "under the Apache License, Version 2.0.",
             "Licensed under the Apache License, Version 2.0.", "é" * 50, "the of in and under license version use this"] + ["plain words of no note"] * 20
    rows = list(enumerate(texts)) + [(3, "MIT License"), (None, "mit license")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS word", "2 AS template", "3 AS n_words")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == brute(text), text
        assert set(r.base_labels) <= set(r["labels"]) and 0 <= r.score <= 1
    assert by_id[8]["labels"] == ["mit"] and by_id[8].n_base == 0
    assert by_id[9]["labels"] == []  # a mandatory phrase is missing
    assert by_id[10]["labels"] == ["cc-by", "cc-by-nc-4.0"]
    assert by_id[11]["labels"] == ["gpl", "gpl-3.0"]
    assert by_id[12]["labels"] == by_id[13]["labels"] == ["apache", "apache-2.0"]
    assert by_id[15]["labels"] == [] and by_id[20]["labels"] == [] and by_id[20].score == 0
    assert by_id[None].base_labels == ["mit"]
    assert licenses.scan(df.limit(0)).collect() == []


def test_several_licenses_and_all_words_in_one_file(spark):
    """A template is found whatever other templates or index words its file holds."""
    full = {}
    for label, template, _ in licenses.TEMPLATES:
        full.setdefault(label, template)
    groups = [("mit", "bsd"), ("mit", "bsd", "apache-2.0"), ("mit", "bsd", "isc"), ("mit", "bsd", "isc", "mpl-2.0", "gpl-3.0"), tuple(full)]
    texts = [" and then ".join(full[x] for x in g) for g in groups]
    every = " ".join(sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) * 2)
    alone = list(licenses.TEMPLATES)
    texts += [f"{every} so {t} so {every}" for _, t, _ in alone] + [every] + ["plain words of no note"] * 60
    got = {r.doc_id: set(r["labels"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, labels in enumerate([*groups, *((label,) for label, _, _ in alone)]):
        assert set(labels) <= got[i], labels
    assert got[len(groups) + len(alone)] == set()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_licenses"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
