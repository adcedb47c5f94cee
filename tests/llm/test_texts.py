import random

import pytest
from pyspark.sql import functions as F

from hashloom.llm import garbled, leakage, mixing

WORDS = "harbour keeper lantern orchard cannery furnace ledger bishop quarry saddle timber velvet walnut yonder zephyr anchor barrel candle drummer engine feather garden hammer island jacket kettle ladder mirror needle orange".split()


def item(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.choice('abcdefghijkm')}{rng.choice(WORDS)[:3]} {rng.randrange(3000)}" if i % 3 == 0 else rng.choice(WORDS) for i in range(n))


def page(seed, n=60):
    rng = random.Random(1000 + seed)
    return " ".join(rng.choice(WORDS + ["the", "of", "and"]) for _ in range(n))


def lines(text, n=7):
    w = text.split()
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)).withColumn("score", F.lit(0))
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}


def test_leaks(spark):
    items = [(i, item(i)) for i in range(20)] + [(50, "too short"), (51, None), (52, "")]
    w = [item(i).split() for i in range(20)]
    advert = ["WANTED a steady man", "apply box 99"]
    inter = [x for a, b in zip(lines(" ".join(w[4][:30])), lines(page(4))) for x in (a, b)]
    shuffled = w[5][:]
    random.Random(1).shuffle(shuffled)
    docs = [
        (0, page(0) + "\n" + item(0) + "\n" + page(1)),
        (1, "\n".join([page(2), *lines(" ".join(w[1][3:31])), page(3)]).upper()),
        (2, "\n".join(lines(" ".join(w[2][:14])) + advert + lines(" ".join(w[2][14:34])))),
        (3, item(3).replace("o", "0", 3).replace("l", "1", 4).replace("rn", "m")),
        (4, "\n".join(inter)),
        (5, " ".join(shuffled)),
        (6, page(6) + " " + " ".join(w[6][:11]) + " " + page(7)),
        (7, item(7).replace("e", "\xc3\xa9e")),
        (8, None), (9, ""), (10, page(9) * 40 + " " + item(8) + " " + page(10) * 40),
    ]
    assert found(spark, docs, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 7), (10, 8)}


def test_leaks_however_much_lies_in_between(spark):
    items = [(i, item(i)) for i in range(20)]
    docs = []
    for i in range(9):
        w, parts, gap = item(i).split()[4:29], 2 + i // 3, (104, 300, 1200)[i % 3]
        cut = [" ".join(w[k * 25 // parts : (k + 1) * 25 // parts]) for k in range(parts)]
        between = [" ".join(f"{x}{k}q" for x in page(40 + i, gap).split()) for k in range(parts)]
        docs.append((i, "\n".join(x for pair in zip(between, cut) for x in pair)))
        docs.append((100 + i, "\n".join(x for pair in zip(between, cut[::-1]) for x in pair)))  # the parts in another order
    assert found(spark, docs, items) == {(i, i) for i in range(9)}


def test_leaks_by_shard_and_empty(spark):
    items = spark.createDataFrame([(i, item(i)) for i in range(9)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, page(i) + " " + item(i)) for i in range(9)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, shard=2).collect()} == {(i, i) for i in range(9)}
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def full_scores(page_words, ix):
    """Every item scored, without pruning."""
    score = [0.0] * len(ix.ids)
    for t in ix.terms(page_words):
        for k in range(ix.at[t], ix.at[t + 1]):
            score[ix.post[k]] += ix.impact[k]
    return score


def test_pruning_loses_nothing():
    texts = [item(i) for i in range(60)]
    texts += [" ".join(texts[i].split()[:20] + texts[i + 1].split()[10:35]) for i in range(0, 58, 2)]  # items made of parts of others
    ix = leakage.build_index(list(enumerate(texts)))
    for i in range(len(texts)):
        p = leakage.words(page(i) + " " + " ".join(texts[i].split()[5:33]) + " " + page(i + 1) + " " + texts[(7 * i) % 60])
        every = [j for j, s in enumerate(full_scores(p, ix)) if s >= ix.need[j] - 1e-9]
        assert every == leakage.candidates(p, ix) and i in every


def test_index_is_linear_in_its_items():
    def weight(ix):
        arrays = (ix.need, ix.block_need, ix.keys, ix.at, ix.post, ix.impact, ix.peak, ix.block_at, ix.blocks, ix.block_peak)
        return sum(a.nbytes for a in arrays)

    small, large = leakage.build_index([(i, item(i)) for i in range(1000)]), leakage.build_index([(i, item(i)) for i in range(10_000)])
    assert weight(large) < 11 * weight(small) and weight(large) < 40_000_000
    assert leakage.candidates(leakage.words(page(1) + " " + item(9321)), large) == [9321]


SENTENCES = {
    "fr": ["Le château près de la forêt était très éloigné ce matin", "Les élèves ont quitté l’hôpital à midi, malgré la grêle", "« la fête est célèbre », a répété Mme Zoé avec fierté"],
    "de": ["Der Bürgermeister eröffnete die Brücke früh am Tage", "Die Behörde ist größer als zuvor, erklärte der Förster", "Über der Mühle zogen Wolken, und die Gäste kehrten zurück"],
    "en": ["The fête at the café — none better — drew 300 bakers", "Señor Delva and Mme. Zoë described the rôle of the jury, naïvely told", "“We have never seen so quiet a harbour,” said Mrs. Brown"],
    "es": ["El señor celebró la elección en la montaña después de la función", "¿Quién mencionó el cañón? Según dicen, está vacío", "Doña Inés vendió piñones así lo quiso el sábado"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rare = [(s, "fr") for s in ("See §12 and ¶ 4", "½ lb . tea ¢ 9") for _ in range(40)]  # rare but correct signs are in the sample as well
    return garbled.train(rare + [("\n".join(rng.choice(s) for _ in range(12)), lang) for lang, s in SENTENCES.items() for _ in range(120)], 16_000)


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
def test_utf8_read_wrongly_is_restored(model, read_as):
    r = garbled.Restorer(model)
    back = {b: c for c, b in garbled._charset(read_as).items()}
    for lang, own in SENTENCES.items():
        for s in own:
            if not s.isascii():
                wrong = "".join(back[b] for b in s.encode())
                hit, text, chains = r.restore(f"{own[0]}\n{wrong}\n{own[1]}", lang)
                assert hit and text.split("\n")[1] == s, (lang, wrong, text, chains)


def test_single_bytes_twice_and_clean(model):
    r = garbled.Restorer(model)
    s = SENTENCES["fr"][0]
    wrong = s.encode("cp1252").decode("mac_roman")
    assert r.restore(wrong, "fr")[:2] == (True, s)
    twice = s.encode().decode("latin-1").encode().decode("latin-1")
    assert r.restore(twice, "fr")[:2] == (True, s)
    for lang, own in SENTENCES.items():
        for clean in [*own, "Ship ÅNGSTRÖM , Capt. ØDEGAARD .", "See §12 and ¶ 4", "Printed by ÇELIK & ÑANDÚ , ©", "½ lb . tea ¢ 9", "Cargo for São Telmo and CORAÇÃO"]:
            assert r.restore(clean, lang)[0] is False, clean
    assert r.restore("a � b", None)[0] and r.restore("a \x93b", "en")[0]
    assert r.restore(None)[0] is False and r.restore("") == (False, "", []) and r.restore("plain")[0] is False


@pytest.fixture(scope="module")
def small():
    """A model of few pages: most words are unknown to it."""
    return garbled.train([("\n".join(s), lang) for lang, s in SENTENCES.items() for _ in range(3)], 4000)


def test_correct_rare_words_stay_with_a_small_sample(small):
    r = garbled.Restorer(small)
    rare = "Bäckerei Gärtner reqión ex~licó l1evó an0tó fuución, maíz río volía ÎLE ZOË FÊTE CAFÉ Händlcr. Ge1äut. Gcläut. Señorío N.½ Señal où tù São"
    for w in rare.split():
        for lang, own in SENTENCES.items():
            text = f"{own[0]}\nDie neue {w} ist da und {w.lower()}\n{own[1]}"
            hit, out, chains = r.restore(text, lang)
            assert not hit and out == text, (w, lang, chains, out)


def test_longer_chains_and_other_scripts(model):
    r = garbled.Restorer(model)
    s = SENTENCES["fr"][0]
    four = s
    for _ in range(4):
        four = four.encode().decode("latin-1")
    assert r.restore(four, "fr")[:2] == (True, s)
    for word in ("правда", "Ελλάδα"):
        wrong = "".join({b: c for c, b in garbled._charset("cp1252").items()}[b] for b in word.encode())
        hit, text, _ = r.restore(f"{SENTENCES['en'][2]}\nthe word {wrong} was read", "en")
        assert hit and text.endswith(f"the word {word} was read")


def test_lost_characters_are_judged_by_length(small):
    r = garbled.Restorer(small)
    for own in SENTENCES.values():
        for s in own:
            for k in range(0, len(s), 7):
                for c in "\ufffd\x81\x9d":
                    assert r.restore(s[:k] + c + s[k:])[2][-1] == garbled.LOST


def test_a_further_language_has_its_own_dictionary(spark):
    rows = [(i, "Zażółć gęślą jaźń\nmały kot śpi na łóżku", "pl") for i in range(40)] + [(100 + i, SENTENCES["en"][i % 3], "en") for i in range(60)] + [(300, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = garbled.model_of(df)
    assert model.own_codes == ("pl",) and "ł" in model.alphabets["pl"]
    assert garbled.Restorer(model).restore("Zażółć gęślą jaźń", "pl")[0] is False
    wrong = "".join({b: c for c, b in garbled._charset("cp1252").items()}[b] for b in "mały kot śpi".encode())
    assert garbled.Restorer(model).restore(wrong, "pl")[:2] == (True, "mały kot śpi")


def test_restored_frame(spark, model):
    s = SENTENCES["de"][0]
    rows = [(1, s.encode().decode("cp1252", "ignore"), "de"), (2, s, None), (3, None, None), (4, "", "xx"), (1, s, "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("garbled", F.lit(7))
    got = sorted((r.doc_id, r.garbled) for r in garbled.restored(df, model).collect())
    assert got == [(1, False), (1, True), (2, False), (3, False), (4, False)]
    assert garbled.restored(df.limit(0)).count() == 0


def test_letters_of_a_rare_language_are_known(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(SENTENCES["en"]) for _ in range(12)), "en") for i in range(400)]
    rows += [(400 + i, "\n".join(SENTENCES["es"] * 4), "es") for i in range(3)]
    s = SENTENCES["es"][0]
    wrong = f"{SENTENCES['es'][2]}\n{s.encode('cp1252').decode('mac_roman')}\n{SENTENCES['es'][1]}"
    df = spark.createDataFrame([*rows, (500, wrong, "es")], "doc_id bigint, text string, lang string")
    real = garbled.sample_pages
    monkeypatch.setattr(garbled, "sample_pages", lambda d, **how: real(d, 16, **how))
    got = {r.doc_id: r.restored for r in garbled.restored(df).where("garbled").collect()}
    assert set(got) == {500} and got[500].split("\n")[1] == s


def test_sample_is_not_filled_by_null_ids_or_copies(spark):
    rows = [(None, f"null {i}", "en") for i in range(500)] + [(7, "copy", "en")] * 300 + [(i, f"page {i}", "en") for i in range(1000, 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = garbled.sample_pages(df, 180)
    assert 0.05 < sum(t.startswith("null") for t, _ in got) / 500 < 0.15 and sum(t == "copy" for t, _ in got) <= 1
    assert 0.05 < sum(t.startswith("page") for t, _ in got) / 1000 < 0.15
    assert sorted(got) == sorted(garbled.sample_pages(df.orderBy(F.desc("text")).repartition(5), 180))


def test_dictionary_lines_do_not_depend_on_order():
    rng = random.Random(8)
    rows = [(f"{' '.join(rng.choice(WORDS) for _ in range(8))} {i} café", "en") for i in range(3000)]
    assert garbled.train(rows, 2000).dictionaries == garbled.train(rows[::-1], 2000).dictionaries


def test_expected_copies():
    c = mixing.expected_copies([("a", 0.5, 1), ("b", 0.3, None), ("c", 0.2, 2), ("gone", 0.1, None)], {"a": 100, "b": 400, "c": 500}, 1000)
    assert c["gone"] == 0 and c["a"] == 1
    assert abs(sum(c[s] * n for s, n in {"a": 100, "b": 400, "c": 500}.items()) - 1000) < 1e-6
    assert abs(c["b"] * 400 / (c["c"] * 500) - 1.5) < 1e-9
    assert mixing.expected_copies([("a", 1.0, 1)], {"a": 10}, 1000) == {"a": 1.0}
    assert mixing.expected_copies([], {}, 5) == {}


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", 50 + i % 40) for i in range(3000)] + [(3000 + i, None, 10) for i in range(5)] + [(4000, "tiny", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("cell", F.lit(1)).withColumn("r", F.lit(1))
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 2), ("absent", 0.0, None), ("tiny", 0.0, None)], "source string, target_share double, max_repeat int")
    comp, report = mixing.mix(sized, targets)
    got, rep = comp.collect(), {r.source: r for r in report.collect()}
    uses = {}
    for r in got:
        uses[r.doc_id] = max(uses.get(r.doc_id, 0), r.copy_no)
    assert max(uses[i] for i in uses if i % 3 == 0) <= 2 and len({(r.doc_id, r.copy_no) for r in got}) == len(got)
    total = sum(t for _, _, t in rows)
    assert abs(sum(r.tokens for r in got) / total - 1) < 0.02
    share = sum(t for _, s, t in rows if s == "small") * 2 / total
    assert abs(rep["small"].actual_share - min(0.7, share)) < 0.02 and rep["absent"].uses == 0
    again = {(r.doc_id, r.copy_no) for r in mixing.mix(sized.repartition(7), targets)[0].collect()}
    assert again == {(r.doc_id, r.copy_no) for r in got}
    assert mixing.mix(sized.limit(0), targets)[0].count() == 0 and mixing.mix(sized, targets.limit(0))[1].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, None, None), (3, "b", ""), (4, "b", "x" * 20000)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100


def test_garbled_tables_without_texts_or_languages(spark):
    schema = "doc_id bigint, text string, lang string"
    for rows in ([], [(1, None, None), (2, "", "en"), (None, None, "xx")], [(i, SENTENCES["fr"][i % 3], None) for i in range(30)]):
        df = spark.createDataFrame(rows, schema).withColumn("name", F.lit("clash")).withColumn("restored", F.lit(1))
        got = garbled.restored(df).collect()
        assert len(got) == len(rows) and not any(r.garbled for r in got)
    wrong = SENTENCES["fr"][0].encode().decode("latin-1")
    df = spark.createDataFrame([(i, SENTENCES["fr"][i % 3], None) for i in range(30)] + [(99, wrong, None), (99, wrong * 400, "fr")], schema)
    assert [r.doc_id for r in garbled.restored(df).where("garbled").collect()] == [99, 99]
