from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.llm import language
from skysieve.llm.common import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = language.op10(spark, d).join(table(spark, d, "documents", "doc_id", "lang"), "doc_id").where("held_out")
    right, total, low = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert total > 200 and right / total > 0.97 and low / total < 0.01


def test_odd_rows(spark, documents, odd_rows):
    texts = {"en": "the quick brown fox jumps over the lazy dog and the cat ", "de": "der schnelle braune fuchs springt über den faulen hund und die katze "}
    model = language.LanguageModel({k: (v * 20).encode() for k, v in texts.items()})
    found = {r["id"]: r for r in language.identify(documents(odd_rows), model).collect()}
    assert len(found) == 8
    for key in (1, 2, 6, 7):
        assert (found[key]["lang_pred"], found[key]["score"], found[key]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert model.predict("Der Hund und die Katze")[0] == "de" and model.predict("THE DOG AND THE CAT")[0] == "en"


def test_no_teacher(spark, documents):
    docs = documents([(1, "words here", None)])
    model = language.trained(docs)
    assert model.dictionaries == {} and language.identify(docs, model).first()["lang_pred"] == "und"
    assert language.identify(documents([]), model).count() == 0


def test_keep_identified(spark, documents):
    model = language.LanguageModel({"en": b"the quick brown fox jumps over the dog " * 9, "fr": "le renard brun saute par dessus le chien ".encode() * 9})
    docs = documents([(1, "the quick brown fox jumps"), (2, None), (3, "1234")]).withColumn("margin", F.lit(1))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_query_against_fresh_compressors(spark):
    import zstandard

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    model = language.trained(docs)
    assert all(len(x) <= language.DICTIONARY for x in model.dictionaries.values())

    def size(text, raw, level, match):
        how = zstandard.ZstdCompressionParameters.from_level(level, source_size=language.CHUNK, dict_size=language.DICTIONARY, min_match=match, write_content_size=False, write_checksum=False, write_dict_id=False)
        shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=how)
        plain = language.normal(text)
        return sum(len(zstandard.ZstdCompressor(dict_data=shared, compression_params=how).compress(plain[a : a + language.CHUNK])) for a in range(0, max(1, len(plain)), language.CHUNK))

    got = {r["doc_id"]: r for r in language.op10(spark, d).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        if not any(map(str.isalpha, text)):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        for how in ((language.LEVEL, language.MATCH), (language.CLOSE_LEVEL, language.CLOSE_MATCH)):
            order = sorted((size(text, raw, *how), name) for name, raw in model.dictionaries.items())
            margin = (order[1][0] - order[0][0]) / order[1][0]
            if margin >= language.MARGIN:
                break
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["margin"]) == (order[0][1], margin)


def test_repeated_ids_teach_once(spark, documents):
    rows = [(1, "der hund und die katze " * 40, "de")] * 50 + [(k, f"the dog {k} and the cat " * 40, "en") for k in range(2, 9)]
    model = language.fit(documents(rows), F.lit(True))
    assert set(model.dictionaries) == {"de", "en"} and len(model.dictionaries["de"]) <= language.PIECE
