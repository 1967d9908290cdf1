import pytest
from pyspark.sql import functions as F

from millrace.llm.languages import declared, item_languages

SCHEMA = "posting_row BIGINT, must_have ARRAY<STRING>, language STRING, geo_country STRING, company_id STRING, part STRING, lang STRING"


@pytest.mark.parametrize("label, code", [
    ("en", "en"), ("EN_us", "en"), ("English (UK)", "en"), ("français", "fr"), ("Deutsch", "de"), ("niemiecki", "de"), ("pt-BR", "pt"), (" Nederlands ", "nl"), ("n/a", None), ("multi", None), ("??", None), ("", None), (None, None), ("sv", None), ("english/german", None),
])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l STRING").select(declared(F.col("l")).alias("d")).first()["d"] == code


TEXT = {
    "en": ["Good knowledge of {} and of {}", "You have worked with {} for years", "You speak with our customers about {}"],
    "de": ["Gute Kenntnisse in {} und auch in {}", "Du hast schon mit {} gearbeitet", "Du sprichst mit unseren Kunden über {}"],
    "fr": ["Bonnes connaissances de {} et aussi de {}", "Vous avez déjà travaillé avec {}", "Vous parlez avec nos clients de {}"],
    "pl": ["Dobra znajomość {} oraz {}", "Masz już doświadczenie w pracy z {}", "Rozmawiasz z naszymi klientami o {}"],
}
LANG = ["en", "de", "fr", "pl"]


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = [], {}
    names = [f"{a}{b}ix" for a in ("Zor", "Mal", "Tek", "Vud", "Ner") for b in ("an", "el", "up", "ob", "ik", "av")]
    for i in range(240):
        l = LANG[i % 4]
        items = [TEXT[l][k % 3].format(names[(i + k) % 30], names[(i + 7 * k) % 30]) for k in range(4)]
        if i % 12 == 1:
            items.append(TEXT["en"][1].format(names[i % 30]) + " / " + TEXT["fr"][2].format(names[i % 30]))
            truth[i, 4] = {"en", "fr"}
        items.append(f"{names[i % 30]}, {names[(i + 5) % 30]}")
        truth.update({(i, k): {l} for k in range(4)})
        rows.append((i, items, l if i % 9 else "unknown", "x", f"c{i % 5}", "clash", "clash"))
    rows += [(900, None, "en", None, None, None, None), (901, [], None, None, None, None, None), (902, [None, "", "  "], "de", "", "", "", ""), (903, ["Du hast schon mit " + "Malelix " * 20_000 + " gearbeitet"], None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    out = item_languages(df, "posting_row", "must_have", "language", "geo_country", "company_id").collect()
    got = {}
    for r in out:
        got.setdefault((r["row"], r["item_idx"]), set()).add(r["lang"])
    return got, truth, out


def test_each_item_and_part_gets_its_language(found):
    got, truth, _ = found
    assert {k: v for k, v in got.items() if k[0] < 900} == truth
    assert got[903, 0] == {"de"} and not any(k[0] in (900, 901, 902) for k in got)


def test_confidence_and_parts(found):
    _, _, out = found
    assert all(0 < r["confidence"] <= 1 for r in out)
    assert {r["part"] for r in out if (r["row"], r["item_idx"]) == (1, 4)} == {1, 2} and {r["part"] for r in out if r["item_idx"] == 0} == {0}


def test_empty(spark):
    assert item_languages(spark.createDataFrame([], SCHEMA), "posting_row", "must_have", "language", "geo_country", "company_id").count() == 0
