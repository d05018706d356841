"""Problem 9: garbled segments found and restored on a corpus whose garbling is known."""

import random

import pytest

from gleanery.llm import encoding as E

WORDS = {
    "fr": "la porte a été réparée après la visite du technicien, à côté de l’entrée où le gérant espère être payé dès août".split(),
    "de": "die Tür schließt während der Störung später für größere Geräte über den Zähler zurück, wo müde Gäste schön fröhlich grüßen".split(),
    "pl": "właściciel łodzi przesunął wizytę późną wiosną, żeby źródło ciepła dostało część zamówień już jutro rano".split(),
    "ru": "мастер сообщил что ворота снова открываются после ремонта хотя датчик показывает ошибку каждый вечер".split(),
}
BAD = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1251", "koi8-r"), ("utf-8", "cp1251")]


def corpus(n=1200, seed=3):
    """(doc_id, text, clean, kind): a tenth is garbled, some in one sentence only."""
    rng = random.Random(seed)
    sentences = [" ".join(rng.choices(w, k=rng.randint(7, 11))) + "." for w in WORDS.values() for _ in range(60)]
    out = []
    for i in range(n):
        s = rng.choices(sentences, k=3)
        clean = " ".join(s)
        kind = rng.choice([*BAD, "lossy"]) if rng.random() < 0.1 else None
        if kind == "lossy":
            s[1] = "".join(c if ord(c) < 128 else "�" for c in s[1])
        elif kind:
            try:
                s[1] = s[1].encode(kind[0]).decode(kind[1])
            except UnicodeError:
                kind = None
        text = " ".join(s)
        out.append((i, text, clean, None if text == clean else str(kind)))
    return out


def test_found_and_restored(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (9003, "plain", None), (9003, "plain", None), (9004, "no stop " * 30_000, "y")], "doc_id bigint, text string, segment string").write.parquet(f"{tmp_path}/documents.parquet")
    bad = {i for i, _, _, k in rows if k}
    found = {r.doc_id for r in E.p9_found(spark, str(tmp_path)).collect()}
    assert len(bad) > 60 and len(bad & found) / len(bad) >= 0.95 and len(found - bad) <= 1
    clean, hits = {i: c for i, _, c, _ in rows}, 0
    for r in E.p9_restored(spark, str(tmp_path)).collect():
        hits += r.text == clean[r.doc_id]
    assert hits / len(bad) >= 0.9


def test_clean_and_empty_corpora_give_nothing(spark, tmp_path):
    rows = [(i, c) for i, _, c, _ in corpus(300)]
    for name, x in (("a", rows), ("b", [])):
        spark.createDataFrame(x, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert E.p9_found(spark, f"{tmp_path}/{name}").count() == 0


@pytest.mark.parametrize("text", ["a. b! c", "no mark", "…. é\n\n x.", " lead"])
def test_segments_join_to_the_text(spark, text):
    rows = E.segments(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("at").collect()
    assert "".join(r.segment for r in rows) == text


def test_alignment():
    assert E.aligned(["Ã©", "â€™"], ["é", "’"]) == [("Ã©", "é"), ("â€™", "’")]
    assert E.aligned(["Ã§Ã£"], ["çã"]) == [("Ã§", "ç"), ("Ã£", "ã")]
    assert E.aligned(["a"], ["b", "c"]) == [] and E.aligned(["é"], ["é"]) == []
    assert E.misread("’", ("utf-8", "cp1252", "kept", 2)) == "Ã¢â‚¬â„¢"


def test_fewest_misreadings():
    one, two = E.misreadings().index(("utf-8", "cp1252", "kept", 1)), E.misreadings().index(("utf-8", "cp437", "kept", 1))
    rows = [{"explained_by": f"{one},{two}", "different": 5, "support": 9}, {"explained_by": str(one), "different": 4, "support": 8}, {"explained_by": str(two), "different": 1, "support": 50}]
    assert E.accepted(rows) == [("utf-8", "cp437", "kept", 1), ("utf-8", "cp1252", "kept", 1)]
