"""Registered queries over whole texts against plain Python, on a few long and hostile documents."""

import hashlib
import re

import pytest

from folioweave.plans import catalog, corpus

TEXTS = ["plain words", None, "", "fence\n```\n# kept in the fence\n```\nend", "long " * 3000, "ÄÖ é ß\n\n\n#nothing", "[link](x.md) and * list\n  indented", "last"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def composed(pages, i, level=1, path=()):
    out = []
    for line in re.split(r"\r\n|\n|\r", pages[i].rstrip("\n")):  # a section ends with its last block
        include = re.fullmatch(r"\[@include: \w+\]\(d(\d+)\.md#d\d+\)", line)
        if include:
            j = int(include[1])
            out += [] if j in (*path, i) else [composed(pages, j, level + 1, (*path, i))]
        else:
            out.append("#" * (level - 1) + line if line.startswith("#") else line)
    return "\n".join(out)


def test_composition_holds_whole_texts(spark, folder):
    pages = {r["doc_id"]: r["content"] for r in corpus.corpus_documents(spark, folder).collect()}
    want = {f"/corpus/d{i}.md#d{i}": composed(pages, i) for i in pages}
    assert all(t in want[f"/corpus/d{i}.md#d{i}"] for i, t in enumerate(TEXTS) if t)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {r["root"]: (r["digest"], r["size"]) for r in catalog.QUERIES["compose_text"](spark, folder).collect()} == {k: (sha(v), len(v)) for k, v in want.items()}
    got = {r["root"]: (r["digest"], r["token_estimate"], r["truncated"]) for r in catalog.QUERIES["context_compose"](spark, folder).collect()}
    assert got == {k: (sha(v[:4000]), len(v[:4000]) // 4, len(v) > 4000) for k, v in want.items()}


@pytest.mark.parametrize("name", ["parse_findings", "next_number", "workflow_status", "workflow_transition"])
def test_bodies_are_parsed(spark, folder, monkeypatch, name):
    seen = []
    real = corpus.rendered
    monkeypatch.setattr(corpus, "rendered", lambda *a, **how: seen.append(real(*a, **how)) or seen[-1])
    catalog.QUERIES[name](spark, folder).collect()
    assert seen and all(d.where("content like '%long long long%'").count() == 1 for d in seen)
