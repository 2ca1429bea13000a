"""Text statistics and structures."""

import pytest

from annotary.llm import quality as Q

PROSE = (
    "The committee met twice in the spring to discuss the plan for the new library. Several members asked whether the building would be large enough for the "
    "town, and the architect showed drawings that had been made for an earlier site. After a long debate it was agreed that the work should begin in the autumn."
)
WRAPPED = "The committee met twice in the spring to discuss\nthe plan for the new library. Several members asked\nwhether the building would be large enough for the\ntown, and the architect showed drawings that had\nbeen made for an earlier site."
CASES = {
    "prose": PROSE, "wrapped": WRAPPED, "upper": PROSE.upper(), "headed": "RESULTS:\n" + PROSE + "\n\nDISCUSSION:\n" + PROSE,
    "with_table": PROSE + "\nrow | 1 | 2\nrow | 3 | 4", "cited": PROSE.replace(". ", ". [4] "),
    "fr": "Le comité s'est réuni deux fois au printemps pour parler du projet de la nouvelle bibliothèque. Les membres ont demandé si le bâtiment serait assez grand pour la ville.",
    "de": "Der Ausschuss traf sich zweimal im Frühling, um über den Plan für die neue Bibliothek zu sprechen. Die Mitglieder fragten, ob das Gebäude für die Stadt groß genug ist.",
    "es": "El comité se reunió dos veces en la primavera para hablar del plan de la nueva biblioteca. Los miembros preguntaron si el edificio era grande para la ciudad.",
}
JUNK = {
    "list": "\n".join(f"- {a} {b}" for a in ("red", "old", "large") for b in ("house", "garden", "bridge")),
    "table": "\n".join(f"item{i} | {i} | 0.{i}5 | {i * 7}" for i in range(10)),
    "csv": "\n".join(f"item{i},{i},0.{i}5,{i * 7}" for i in range(10)),
    "markup": "".join(f'<item id="{i}"><name>garden</name><size>{i}</size></item>\n' for i in range(10)),
    "sequence": ">x1\n" + "GATTACACCGTATCGGATTACAGGCATCGATCGATTACGGACTTACGATCAGCATTACGAGC\n" * 1 + "TTGACATCGGATCAACGTTAGCATCAGGATTACGCCATATCGGACCATTACGGATCTACGAT",
    "repeated": ("A new bridge for the old town of the north.\n") * 12,
    "salad": "the of and was to in for on with by from as at were is that this the of to and in a for was on by with from at " * 3,
    "encoded": "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZmdoaWprbG1ub3BxcnN0dXZ3eHl6QUJDREVGR0hJSktMTU5P" * 4,
}


@pytest.mark.parametrize("name", CASES)
def test_prose(name):
    got = Q.judge([CASES[name]]).iloc[0]
    assert got["is_prose"], got["structure"]


@pytest.mark.parametrize("name", JUNK)
def test_junk(name):
    got = Q.judge([JUNK[name]]).iloc[0]
    assert not got["is_prose"], got["structure"]


OTHER = {
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由，不分种族、肤色、性别、语言。人人有权享有生命、自由和人身安全。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه. لا يجوز استرقاق أو استعباد أي شخص.",
}
OTHER_JUNK = {
    "ru_list": "\n".join(["старый дом", "красный сад", "мост", "река", "белый снег", "лес", "поле", "дорога"]),
    "ru_table": "\n".join(f"дом{i} | {i} | 0.{i}5 | {i * 7}" for i in range(10)),
    "ru_repeated": "Новый мост для старого города на севере страны.\n" * 12,
}


@pytest.mark.parametrize("name", [*OTHER, *OTHER_JUNK])
def test_other_scripts(name):
    got = Q.judge([OTHER.get(name) or OTHER_JUNK[name]]).iloc[0]
    assert got["is_prose"] == (name in OTHER), got["structure"]


def test_letters_of_all_scripts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(OTHER.values())], "id long, text string")
    assert all(r["symbol_ratio"] < 0.13 for r in Q.counts(df).collect())


def test_counts(spark):
    df = spark.createDataFrame([(1, "One two three. Four, of the five!\nno end"), (2, None), (3, ""), (4, "  \n\t")], "id long, text string")
    got = {r["id"]: r for r in Q.counts(df).collect()}
    assert got[1]["n_words"] == 9 and got[1]["punctuated_lines"] == 0.5 and got[1]["common_words"] == round(3 / 9, 6)
    assert 0 < got[1]["symbol_ratio"] < 0.2 and got[1]["mean_word_length"] == round(sum(map(len, "One two three. Four, of the five! no end".split())) / 9, 6)
    assert all(tuple(got[i])[1:] == (0, 0.0, 0.0, 0.0, 0.0) for i in (2, 3, 4))


def test_divergence_bounds():
    import numpy as np

    p = np.array([[1.0, 0, 3], [0, 2, 0]])
    assert abs(Q.divergence(p, np.array([1.0, 0, 3]))[0]) < 1e-12 and abs(Q.divergence(p, np.array([1.0, 0, 3]))[1] - 1) < 1e-12


def test_table(spark):
    data = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, JUNK["table"]), (5, JUNK["table"]), (6, PROSE + " " + "The end of the story is not known to us. " * 1 + "x" * 200_000), (7, "x"), (8, "é\x00퟿"), (None, PROSE)]
    df = spark.createDataFrame([(*d, "c", 1) for d in data], "id long, text string, structure string, n_words int")
    got: dict = {}
    for r in Q.statistics(df).collect():
        got.setdefault(r["id"], []).append(r)
    assert got[1][0]["is_prose"] and got[None][0]["is_prose"] and len(got[5]) == 2 and got[5][0] == got[5][1]
    assert all(got[i][0]["structure"] == "empty" and got[i][0]["is_prose"] is None and got[i][0]["n_words"] == 0 for i in (2, 3, 4))
    assert got[7][0]["n_words"] == 1
    assert Q.statistics(df.limit(0)).count() == 0
