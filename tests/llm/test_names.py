"""Look-alikes, wrong encodings, layout copies, spelling variants and linkage: small fixtures, edge cases, brute force."""

import random
import string

import numpy as np
import pytest

from tamisol.llm import copies, garbled, linkage, lookalikes, metric, names, variants


# --- wrong encodings -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250"])
@pytest.mark.parametrize("text", ["José Ángel Muñoz", "Çağrı Gönül", "Łukasz Dvořák", "FUNDACIÓN NÍSPERO"])
def test_round_trip_of_a_wrong_decoding(codec, text):
    wrong = "".join(c if c < "\x80" else "".join(bytes([b]).decode(codec, "replace") if codec != "cp1252" else _sloppy(b) for b in c.encode()) for c in text)
    if "�" not in wrong:
        assert garbled.repair(wrong) == (text, True)


def _sloppy(b: int) -> str:
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def test_double_and_single_byte_and_lost():
    twice = "Vélmora".encode().decode("cp1252").encode().decode("cp1252")
    assert garbled.repair(twice) == ("Vélmora", True)
    assert garbled.repair("Станислав".encode("cp1251").decode("latin-1")) == ("Станислав", True)
    assert garbled.repair("Наталия".encode("koi8_r").decode("cp1251")) == ("Наталия", True)
    assert garbled.repair("Bego�a")[1]


@pytest.mark.parametrize("text", ["São Braído", "Şirvanköy", "JOÃO ÂNGELA", "Рівне", "محمد", "Þórdís Ægir", "R&amp;D", "18 °C – “quoted” …", "\\u00e9tat", "Øyvind", "Çağrı Üçöz"])
def test_correct_text_stays(text):
    assert garbled.repair(text) == (text, False)


@pytest.mark.parametrize("wrong,right", [("TÃœLDSTODINGER, Björn", "TÜLDSTODINGER, Björn"), ("Keltouvand A.Åž.", "Keltouvand A.Ş."), ("Ã–mer Mınhuçı", "Ömer Mınhuçı"), ("ROPUEDUÃ‘A, Manuel", "ROPUEDUÑA, Manuel"), ("Pueblo NÃ\u00adspero", "Pueblo Níspero"), ("KĂ–ZMODEMIR", "KÖZMODEMIR"), ("SURRALUÃƒâ€˜A", "SURRALUÑA")])
def test_cheap_sequences_are_searched(wrong, right):
    assert garbled.repair(wrong) == (right, True)


@pytest.mark.parametrize("text", ["„DAS MENÜ“ – “IRMÃ”", "Гњилане", "SPÄŤ", "KÖ–BERLIN", "Ås", "São João–Açu"])
def test_letters_that_only_resemble_sequences_stay(text):
    assert garbled.repair(text) == (text, False)


def test_records_and_edges(spark):
    raw = ['{"a": ["caf\\u00c3\\u00a9", 1], "b": {"c": "ok"}}', '"{\\"a\\": \\"caf\\u00c3\\u00a9\\"}"', '{"a": "cafÃ©', None, "", "{}", '{"a": "caf\\u00e9"}']
    df = spark.createDataFrame([(i, "x" if i else "Ã©mile", r, "clash") for i, r in enumerate(raw)], "id long, full_name string, raw_data string, field string")
    got = {(r.id, r.field): r.restored for r in garbled.repaired(df, "id", "full_name", "raw_data").collect()}
    assert set(got) == {(0, "full_name"), (0, "raw_data"), (1, "raw_data"), (2, "raw_data")}
    assert got[0, "full_name"] == "émile" and '"café"' in got[0, "raw_data"]
    assert garbled.repaired(df.limit(0), "id", "full_name", "raw_data").count() == 0
    long = spark.createDataFrame([(1, "a" * 200_000 + "Ã©")], "id long, full_name string")
    assert garbled.repaired(long, "id", "full_name").collect()[0].restored.endswith("aé")


# --- look-alikes -----------------------------------------------------------------------------------------------------
def test_classes_are_transitive_and_written_by_frequency():
    r = lookalikes.Rewriter({"a": 50, "\u0430": 5, "\uff41": 2, "\U0001d41a": 1, "\u00e9": 3, "\u0301": 2, "\u200b": 1, "\u00a0": 1, "\ufb01": 1})
    one = next(c for c in r.classes.values() if "a" in c)
    assert {"a", "\u0430", "\u03b1", "\uff41", "\U0001d41a"} <= set(one)
    assert r.rewrite("\uff41\U0001d41ae\u0301\u200b\u00a0\ufb01") == ("aa\u00e9 fi", {"compatibility", "accent", "invisible", "space"})
    assert r.rewrite("Mаria") == ("Maria", {"mixed"})
    assert r.rewrite("Мария Ivan") == ("Мария Ivan", set())
    assert r.rewrite("Петрoв") == ("Петров", {"mixed"})
    # the form has no finding left, whatever the script of the look-alike
    for odd, right in (("\u0555ne", "One"), ("\u13df\u0430rla", "Carla"), ("B\u03bfr\u0456s", "Boris"), ("dav\u0456\u0501", "david"), ("\u0578ada", "nada")):
        form, why = r.rewrite(odd)
        assert (form, why) == (right, {"mixed"}) and r.rewrite(form) == (form, set())


def test_canonical_names(spark):
    rows = [(1, "Jos\u00e9"), (2, "Jose\u0301"), (3, None), (4, ""), (5, "\uff21\uff4e\uff41"), (6, "O\u2019Neil"), (7, "Fran\u251c\u00baois"), (8, "A\u00a0B"), (9, "x\ty"), (9, "x\ty")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, full_name string, reasons string")
    kyc = spark.createDataFrame([("C1", "Z\u200bara"), ("C2", "ok")], "customer_id string, full_name string")
    got = [(r.table_name, r.row_key, r.canonical, list(r.reasons)) for r in lookalikes.canonical_names(df, kyc).collect()]
    by = {k: (c, w) for _, k, c, w in got}
    assert by["1"] == by["2"][:1] + ([],) and by["2"][1] == ["accent"] and by["3"] == (None, []) and by["5"] == ("Ana", ["compatibility"])
    assert by["6"][1] == [] and by["7"] == ("François", []) and by["8"] == ("A B", ["space"]) and by["C1"] == ("Zara", ["invisible"])
    assert sorted((r.table_name, r.row_key) for r in lookalikes.found(df, kyc).collect()) == [("customer_kyc", "C1"), ("sanctions", "2"), ("sanctions", "5"), ("sanctions", "8")]
    assert lookalikes.canonical_names(df.limit(0), kyc.limit(0)).count() == 0


# --- layout copies ---------------------------------------------------------------------------------------------------
COLUMNS = "id long, source string, dob string, nationality string, entity_type string, program string, listed_on string, full_name string, last_name string, first_name string, raw_data string"


def copy_rows():
    base = ("s", "1960", "", "i", "P", "x", "Berg, Anna-Lena", "Berg", "Anna-Lena", '{"a": [1, 2], "b": {"c": null}}')
    change = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(COLUMNS.split(", ")[1:], base, strict=True))
    return [
        (1, *base),
        (2, *change(full_name="ANNA LENA  BERG", nationality=None, last_name="anna-lena", first_name="BERG", raw_data='{"b": {"c": null}, "a": [1, 2]}')),
        (3, *change(full_name="Berg Anna Lena.", raw_data='"{\\"b\\": {\\"c\\": null}, \\"a\\": [1, 2]}"')),
        (4, *change(raw_data='{"a": [2, 1], "b": {"c": null}}')),
        (5, *change(source="t")),
        (6, *change(full_name="Berg, Anna-Len\u0430")),
        (7, *change(dob="1961")),
        (8, *change(full_name="\u0130nci S.A. \u00df", last_name=None, first_name=None)),
        (9, *change(full_name="\u0130NCI SA SS", last_name="", first_name="")),
        (10, *change(full_name=None, raw_data=None)),
        (11, *change(full_name="", raw_data="")),
    ]


def test_copies_match_pairwise_comparison(spark):
    rows = copy_rows()
    df = spark.createDataFrame(rows + rows[:1], COLUMNS)
    got = sorted(tuple(r) for r in copies.copies(df).collect())
    fields = [c.split()[0] for c in COLUMNS.split(", ")]
    records = {r[0]: dict(zip(fields, r, strict=True)) for r in rows}
    kept: dict[int, int] = {}
    for i in records:
        kept[i] = next((j for j in records if j < i and kept[j] == j and copies.same(records[i], records[j])), i)
    assert got == sorted((j, i) for i, j in kept.items() if i != j) == [(1, 2), (1, 3), (8, 9), (10, 11)]
    # fields that are normalised on request
    base = copy_rows()[0]
    at = 1 + fields[1:].index("program")
    more = spark.createDataFrame([base, (20, *base[1:at], base[at].lower(), *base[at + 1 :])], COLUMNS)
    assert copies.copies(more).count() == 0 and [tuple(r) for r in copies.copies(more, loose=frozenset(["program", "raw_data"])).collect()] == [(1, 20)]
    counts = {r.id: r.copies for r in copies.collapsed(df).collect()}
    assert counts == {1: 3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2, 10: 2}
    assert copies.copies(df.limit(0)).count() == 0


# --- spelling variants -----------------------------------------------------------------------------------------------
def test_edits_agree_with_the_metric():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        d = names.distance(a, b)
        assert (names.edits(a, b, 1) <= 1) == (d <= 1) and d <= names.edits(a, b, 12)


@pytest.mark.parametrize("halves", [0, 2, 5])
def test_radius_join_equals_brute_force(spark, halves, monkeypatch):
    rng = random.Random(halves)
    texts = sorted({"".join(rng.choice("rnlmtskdbgfpzjxa") for _ in range(rng.randrange(9))) for _ in range(500)})
    more = sorted({t[: len(t) // 2] + rng.choice(string.ascii_lowercase) + t[len(t) // 2 :] for t in texts[::3]} | set(texts[::5]))
    chosen = [metric.half(k) for k in range(halves)]
    monkeypatch.setattr(metric, "pivots", lambda rows: chosen)
    q, m = (spark.createDataFrame([(t,) for t in x] + [(None,), (x[0],)], "text string") for x in (more, texts))
    got = [(r.query, r.member) for r in metric.within_radius(q, m).collect()]
    assert len(got) == len(set(got)) and set(got) == metric.brute(more, texts)
    # the triangle inequality that the cells rest on, for every pivot
    for a, b in got:
        assert abs(len(a) - len(b)) <= 1
        assert all(abs(metric.distance_to_half(a, h, 20) - metric.distance_to_half(b, h, 20)) <= 1 for h in chosen)


@pytest.mark.parametrize("halves", [0, 3])
def test_wider_radius(spark, halves, monkeypatch):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("rnlmtskd") for _ in range(rng.randrange(8))) for _ in range(150)})
    monkeypatch.setattr(metric, "pivots", lambda rows: [metric.half(k) for k in range(halves)])
    q = spark.createDataFrame([(t,) for t in texts[::2]], "text string")
    m = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = metric.within_radius(q, m, 2).collect()
    assert {(r.query, r.member) for r in rows} == metric.brute(texts[::2], texts, 2) and len(rows) == len(set(rows)) and all(r.apart == names.distance(r.query, r.member) for r in rows)


SAME = [
    ("Al-Thalkhanein, Hoosein", "Husseeen AlThalkhanein"), ("A. Maksimovich Smyarsunevich", "Anatoly Smyarsunevich"), ("Maryam Ghaalfoulāwī", "ماريام غالفولاوي"), ("Irina Krikrorin", "Ирина Крикрорин"),
    ("Gen Nokkucan Invest Estab.", "M/s General Nokkucan Investment Establishment"), ("Mr. Dima Zhorayuk", "Zhorayuk, Dmitri Romanovna"), ("YUSUFTAINRANAVI", "Yusuf Tainranawi"), ("KariÃ±a Nora", "Kariña Nora"), ("Bill Ashworth", "Ashworth, William"), ("Bob Tarrington", "Robert Tarrington"), ("Liz Pemberton", "Elizabeth Pemberton"), ("A (B C) (D E) (F G) (H I) (J Kowalczyk)", "J. Kowalczyk"),
]
OTHER = [("Irina Smitson", "Olga Smitson"), ("Textiles Beerodula FZE", "Beerodula Mining FZE"), ("Omar Wahidi", "Anatoly Smyarsunevich"), ("", "x")]


def test_name_scores():
    assert all(names.score(names.packed(a), names.packed(b)) >= variants.LEAST for a, b in SAME)
    assert all(names.score(names.packed(a), names.packed(b)) < variants.LEAST for a, b in OTHER)


def test_links(spark):
    alerts = [("A1", "C1", "Nadia Korvulinger", "Smyarsunevich A", "L1"), ("A1", "C1", "Nadia Korvulinger", "Smyarsunevich A", "L1"), ("A2", "C2", "Bo Hansen", None, "L1"), ("A3", "C2", None, "Nobody Whatever", "L1"), ("A4", None, "", "Anatoly Smyarsunevich", "L2"), (None, "C9", "x", "", None)]
    lists = [(1, "L1", "Anatoly Smyarsunevich"), (2, "L1", "SMYARSUNEVICH, Anatoly"), (3, "L2", "Anatoly Smiarsunevich"), (4, "L1", None), (5, "L1", "Olga Smyarsunevich"), (6, None, "Anatoly Smyarsunevich")]
    cases = [("K1", "nadia korvulingr"), ("K2", None), ("K3", "")]
    a = spark.createDataFrame(alerts, "alert_id string, customer_id string, customer_name string, matched_entity string, source_list string")
    s = spark.createDataFrame(lists, "id long, source string, full_name string")
    c = spark.createDataFrame(cases, "case_id string, name_queried string")
    got = sorted((r.link, r.left_key, r.right_key) for r in variants.entity_and_case_links(a, s, c).collect())
    assert got == [("case", "K1", "C1"), ("entity", "A1", "1"), ("entity", "A1", "2"), ("entity", "A4", "3")]
    rows = sorted((r.link, r.relation, r.left_key, r.right_key) for r in variants.name_classes(a, s, c).collect() if r.right_key not in ("4", "5"))
    assert rows == [("case", "link", "K1", "C1"), ("entity", "link", "A1", "1"), ("entity", "link", "A1", "2"), ("entity", "link", "A4", "3")]
    twice = s.union(spark.createDataFrame([(9, "L1", "anatoly  SMYARSUNEVICH")], s.schema))
    rows = {(r.relation, r.left_key, r.right_key) for r in variants.name_classes(a, twice, c).collect() if r.link == "entity"}
    assert {("link", "A1", "1"), ("link", "A1", "2"), ("listed", "1", "9")} <= rows and ("link", "A1", "9") not in rows
    assert variants.entity_and_case_links(a.limit(0), s.limit(0), c.limit(0)).count() == variants.name_classes(a.limit(0), s.limit(0), c.limit(0)).count() == 0


# --- linkage ---------------------------------------------------------------------------------------------------------
def test_birth_ranges():
    f = linkage.birth
    assert f("2 Jan 1990", "1990-01-02") == "1990-01-02|1990-01-02|D" and f("1990", "1990-01-01") == "1990-01-01|1990-12-31|Y"
    assert f("June 1975", "1975-06-01") == "1975-06-01|1975-06-31|M" and f("1946-1948", "1946-01-01") == "1946-01-01|1948-12-31|Y"
    assert f("19760101", "1976-01-01")[-1] == "D" and f("01/01/1976", "1976-01-01")[-1] == "D" and f("dd/mm/1976", "1976-01-01")[-1] == "Y" and f(None, None) == ""
    assert linkage.dates_level(f("1990", "1990-01-01"), f("2 Jan 1990", "1990-01-02")) == 3 and linkage.dates_level("", "x|y|D") == 1
    assert linkage.country("iranian") == linkage.country("IR") == linkage.country(" Iran ") == "IR" and linkage.country(None) == ""


def test_matches_and_namesakes(spark):
    rng = random.Random(1)
    syllables = ["kor", "vul", "smyar", "stol", "brid", "fan", "gorm", "lint", "zhel", "mosk", "tarn", "phel", "dosk", "rimb", "quet"]
    given = ["Anna", "Boris", "Carla", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ingrid", "Jamal"]
    countries = [c.split("|")[:2] for c in linkage.COUNTRIES.strip().split("\n")]
    rows, truth, n = [], set(), 0
    for k in range(400):
        g, f = rng.choice(given), "".join(rng.sample(syllables, 3)).capitalize()
        day = f"{rng.randrange(1940, 2000)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        code, country = rng.choice(countries)
        rows.append((n, "L1", f"{g} {f}", country, day))
        if k % 2:
            typo = f[:4] + f[5:] if k % 4 == 1 else f
            rows.append((n + 1, "L2", f"{typo.upper()}, {g}", code, day if k % 3 else day[:4]))
            truth.add((n, n + 1))
        else:
            rows.append((n + 1, "L2", f"{g} {f}", rng.choice(countries)[0], f"{int(day[:4]) + 25}-01-05"))  # a namesake
        n += 2
    rows += [(n, "L3", None, None, None), (n + 1, "L3", "", "", ""), (n + 2, None, "Anna X", "", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, source string, full_name string, nationality string, dob string, word string")
    conv = spark.createDataFrame([("L1", "UTC", "DMY")], "source string, time_zone string, day_order string")
    got = {(r.id_a, r.id_b): r.confidence for r in linkage.matches(df, conv).collect()}
    right = len(truth & set(got))
    assert right >= 0.95 * len(truth) and right >= 0.95 * len(got) and all(0.5 <= c <= 1 for c in got.values())
    assert linkage.matches(df.limit(0), conv).count() == 0
    # pairs of profiles and their members say the same
    rows = linkage.classes(df, conv).collect()
    source, profile = {r[0]: r[1] for r in rows_of(df)}, {r.id_b: r.id_a for r in rows if r.relation == "member"}
    group = {}
    for i in source:
        group.setdefault(profile.get(i, i), []).append(i)
    linked = {(a, a) for a in group} | {(r.id_a, r.id_b) for r in rows if r.relation == "match"}
    assert {(min(x, y), max(x, y)) for a, b in linked for x in group.get(a, ()) for y in group.get(b, ()) if source[x] and source[y] and source[x] != source[y]} == set(got)


def rows_of(df):
    return [tuple(r) for r in df.filter("full_name <> ''").select("id", "source").collect()]


def test_countries(spark):
    codes = linkage.country_codes(spark)
    assert [linkage.country(x, codes) for x in ("NO", "norway", "NOR", " Sri  Lankan ", "Wonderland", None, "Egypt")] == ["NO", "NO", "NO", "LK", "WONDERLAND", "", "EG"] and len(set(codes.values())) > 240


def test_common_words_misspelt_still_meet(spark):
    # given and family name are common, so rows of just these two have no telling word; one typo makes one
    common = variants.Common(names.spelling(w) for w in ("marina", "petrenko", "olga", "sidorova"))
    keys = lambda t: {k for k, _, _ in variants.key_words(names.packed(t), common)}
    for a, b in (("Marina Petrenko", "Marina Petrenkop"), ("Marina Petrenko", "Marina Betrenko"), ("Olga Sidorova", "Olga Tidorova"), ("Olga Sidorova", "Olpa Sidorova")):
        assert metric.brute(keys(a), keys(b)), (a, b)
    firsts, lasts = ("Marina", "Oksana", "Galina", "Tamara"), ("Petrenko", "Sidorova", "Kovalchuk", "Bondarenko")
    listed = [(f"{f} {x} {chr(97 + i)}", i) for i in range(6) for f in firsts for x in lasts]
    s = spark.createDataFrame([(k, "L", t) for k, (t, _) in enumerate(listed)], "id long, source string, full_name string")
    a = spark.createDataFrame([("t", "L", "c", "Marina Petrenkop a", "Nobody")], "alert_id string, source_list string, customer_id string, matched_entity string, customer_name string")
    c = spark.createDataFrame([], "case_id string, name_queried string")
    got = {r.right_key for r in variants.entity_and_case_links(a, s, c).collect() if r.link == "entity"}
    assert str(next(k for k, (t, _) in enumerate(listed) if t == "Marina Petrenko a")) in got


def test_matches_do_not_depend_on_what_has_nothing_in_common():
    """A larger table proposes ever more pairs by chance: those with nothing in common change no verdict, and a rare shared word counts more than a frequent one."""
    rng = np.random.default_rng(3)
    counts = np.zeros(linkage.SIZES)
    for match in (True, False):
        for _ in range(2_000 if match else 20_000):
            name = rng.choice([3, 4, 5], p=[0.1, 0.3, 0.6]) if match else rng.choice([1, 2, 3, 4], p=[0.6, 0.1, 0.2, 0.1])
            rare = rng.choice([0, 1, 2, 3]) if match else rng.choice([2, 4, 5, 6], p=[0.1, 0.3, 0.3, 0.3])
            date = rng.choice([1, 3, 5], p=[0.4, 0.2, 0.4]) if match else rng.choice([0, 1], p=[0.6, 0.4])
            counts[name, rare, date, rng.choice([1, 2]) if match else rng.choice([0, 1])] += 1
    more = counts.copy()
    more[0, 5, 1, 0] += 2_000_000
    few, many = (linkage.posterior(*linkage.fit(c)) for c in (counts, more))
    assert few == pytest.approx(many) and many[4, 1, 1, 1] >= 0.9 and many[4, 6, 1, 1] < 0.1 and not many[0].any()


def test_rarity_of_shared_words(spark):
    rows = [(i, f"Anna Kordovsky {'abcdefgh'[i % 8]}x{i}", "", "") for i in range(6)] + [(10, "Mira Plenzburg", "", ""), (11, "Mira Plenzburk", "", "")]
    got = {(r.a, r.b): r.rare for r in linkage.candidate_pairs(spark.createDataFrame([(names.packed(n), d, c, i) for i, n, d, c in rows], "packed string, dob string, nation string, profile long")).collect()}
    assert got[0, 1] == 1 and got[10, 11] == 0 and all((i, i) in got for i, *_ in rows)


def test_names_of_a_common_word_meet():
    common = variants.Common(["klusmeski", names.spelling("klusmesky")])
    keys = lambda t: {k for k, _, _ in variants.key_words(names.packed(t), common)}
    full = keys("Klusmesky Northern Textiles Limited")
    assert all(keys(t) & full for t in ("Klusmesky Northern Textiles Ltd", "Northern Klusmesky Textiles", "Kluswesky Textiles Limited")) and keys("Klusmesky Ltd") & keys("Klusmesky Limited")


def test_words_are_prepared_once(monkeypatch):
    seen: list[str] = []
    plain = names.spelling
    monkeypatch.setattr(names, "spelling", lambda w: seen.append(w) or plain(w))
    common = variants.Common(["ivan"])
    for name in ("ivan klusmesky", "ivan klusmesky petrovich", "klusmesky ivan"):
        assert ("klsmsk", "klusmeski", "i") in [(k, s, i[:1]) for k, s, i in variants.key_words(name, common)]
    # neither a word again nor a whole name that isn't a key
    assert sorted(seen) == ["ivan", "klusmesky", "petrovich"]


def test_best_links_score_each_pair_once(monkeypatch):
    asked: list[tuple[str, str]] = []
    monkeypatch.setattr(names, "score", lambda a, b: asked.append((a, b)) or {"b": 1.0, "c": 0.84, "d": 0.83, "e": 0.62, "f": 0.61}[b])
    rows = [("s", "x", y) for y in "bcdbcf"] + [("t", "x", y) for y in "effe"] + [("s", "y", "f")]
    assert sorted(variants.best_links(rows)) == [("s", "x", "b", 1.0), ("s", "x", "c", 0.84), ("t", "x", "e", 0.62)]
    assert len(asked) == 7 and list(variants.best_links([])) == []


def test_letters_are_written_as_whole_texts_are():
    for text in ("Łódź ÅNGSTRÖM ǅ", "Ёлка Щука Їжак", "مُحَمَّد أحمد", "Nguyễn Đỗ", "İnci ΣΑΣ ﬁ ｆｕｌｌ", "각 が"):
        whole = names.unicodedata.normalize("NFKD", text.lower().translate(names._TABLE)).translate(names._TABLE)
        assert names.latin(text) == "".join(c for c in whole if not names.unicodedata.combining(c))
