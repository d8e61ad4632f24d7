import random

from pyspark.sql import functions as F

from galley import rules as ru
from galley.functions import text as tx
from galley.operators import bibliography, captions, citations, features, formulas, headings, quality, revision, structure, tables, zones
from galley.operators.labels import TYPE_CATEGORIES
from galley.plans import reports
from galley.rules import default_rules
from galley.scan import scan
from tests.conftest import rows

RULES = default_rules()


def manuscript(spark, *docs):
    data = [(d, i, t) for d, texts in enumerate(docs, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, idx int, text string")


def list_numbers(paragraphs):
    """Counters per list, kept one by one, as plain Python states them."""
    out, counters, seen = {}, {}, {}
    for i, (text, level, list_id) in enumerate(paragraphs):
        head = text.split(" ")[0]
        if head.replace(".", "").isdigit() and " " in text:
            out[i] = head.rstrip(".")
            continue
        if not text or level is None or list_id is None:
            continue
        between = paragraphs[seen[list_id] + 1 : i] if list_id in seen else []
        if list_id not in seen or any(t and n != list_id for t, _, n in between):
            counters[list_id] = [0] * 9
        c = counters[list_id]
        c[level] += 1
        for k in range(level):
            c[k] = c[k] or 1
        c[level + 1 :] = [0] * (8 - level)
        out[i] = ".".join(map(str, c[: level + 1]))
        seen[list_id] = i
    return out


def test_derived_numbers_equal_counters(spark, blocks):
    rng = random.Random(3)
    docs = [
        [(rng.choice(["x", "x", "x", "", "1. y"]), *rng.choice([(None, None), (0, 5), (1, 5), (2, 5), (0, 6), (1, 6)]))
         for _ in range(40)]
        for _ in range(4)
    ]
    data = [(d, i, *p) for d, doc in enumerate(docs) for i, p in enumerate(doc)]
    df = spark.createDataFrame(data, "doc_id long, idx int, text string, numpr_ilvl int, numpr_num_id int")
    got = features.derived_numbers(features.basic_features(df)).select("doc_id", "idx", "derived_number").collect()
    for r in got:
        assert r.derived_number == list_numbers(docs[r.doc_id]).get(r.idx), (r, docs[r.doc_id][: r.idx + 1])


def greedy(detected, expected):
    used, pairs = set(), []
    for e in expected:
        for d in detected:
            any_place = e[1] in quality.DOCUMENT_TYPES or e[2] is None or d[2] is None
            if d[3] in used or d[:2] != e[:2] or not (any_place or abs(d[2] - e[2]) <= 2):
                continue
            used.add(d[3])
            pairs.append((e[0], e[1], e[3], d[3]))
            break
    return sorted(pairs)


def test_matching_equals_greedy(spark, blocks):
    rng = random.Random(11)

    def side(n):
        out = []
        for seq in range(n):
            kind = rng.choice(["placed", "mixed", "bibliography_missing", "loose"])
            place = None if kind == "loose" or (kind == "mixed" and rng.random() < 0.3) else rng.randint(0, 6)
            out.append((rng.randint(1, 2), kind, place, seq))
        return out

    detected, expected = side(70), side(60)
    schema = "doc_id long, type string, paragraph_index int, seq long"
    got = quality.match_findings(spark.createDataFrame(detected, schema), spark.createDataFrame(expected, schema))
    assert rows(got.select("doc_id", "type", "exp_seq", "det_seq")) == sorted(greedy(detected, expected), key=repr)


def test_citation_range_and_reverse(spark):
    df = features.basic_features(manuscript(spark, ["см. [9-3] [2, 4-5] [1-3-5]"])).withColumn("in_title", F.lit(False))
    assert [r.n for r in citations.citations(df).orderBy("token_no", "part_no", "n_pos").collect()] == [2, 4, 5]


def first_places(ranges):
    """First place of every number, by walking through the numbers one by one."""
    found = {}
    for doc, idx, token, part, lo, hi in sorted(ranges, key=lambda r: r[:4]):
        for n in range(lo, hi + 1):
            found.setdefault((doc, n), (idx, token, part))
    return found


def random_ranges(rng, count, top):
    out = []
    for _ in range(count):
        lo = rng.randint(0, top)
        out.append((rng.randint(1, 2), rng.randint(0, 9), rng.randint(0, 2), rng.randint(0, 2), lo, lo + rng.choice([0, 0, 0, 2, 9, rng.randint(0, top)])))
    return list({r[:4]: r for r in out}.values())


RANGES = "doc_id long, idx int, token_no long, part_no long, lo long, hi long"


def with_tokens(spark, ranges):
    return spark.createDataFrame(ranges, RANGES).withColumn("raw_token", F.concat_ws("-", "idx", "token_no"))


def test_first_mentions_equal_walk(spark):
    for seed, count, top in ((1, 30, 12), (2, 60, 400)):
        ranges = random_ranges(random.Random(seed), count, top)
        want = first_places(ranges)
        pieces = citations.first_mentions(with_tokens(spark, ranges)).collect()
        got = [((r.doc_id, n), (r.idx, r.token_no, r.part_no)) for r in pieces for n in range(r.lo, r.hi + 1)]
        assert len(got) == len(want) and dict(got) == want


def test_citation_order_equals_walk(spark):
    ranges = random_ranges(random.Random(5), 40, 30)
    want = {}
    for doc in {r[0] for r in ranges}:
        numbers = [n for (d, n), at in sorted(first_places(ranges).items(), key=lambda x: (x[1], x[0][1])) if d == doc]
        falls = sum(a > b for a, b in zip(numbers, numbers[1:]))
        want[doc] = (len(numbers) - 1, falls, "[" + ", ".join(map(str, numbers[:15])) + "]")
    got = citations.citation_order(citations.first_mentions(with_tokens(spark, ranges))).collect()
    assert {r.doc_id: (r.pairs, r.inversions, r.shown) for r in got} == want


def test_missing_sources_equal_walk(spark):
    rng = random.Random(8)
    ranges = random_ranges(rng, 40, 60)
    listed = [(1, rng.randint(0, 80)) for _ in range(30)]
    entries = spark.createDataFrame(listed, "doc_id long, number long")
    want = [(d, n, *at[:1]) for (d, n), at in first_places(ranges).items() if d == 1 and (d, n) not in set(listed)]
    runs = bibliography.missing_runs(citations.first_mentions(with_tokens(spark, ranges)), entries).collect()
    assert sorted((r.doc_id, n, r.idx) for r in runs for n in range(r.lo, r.hi + 1)) == sorted(want)


def test_absurd_ranges_are_not_expanded(spark):
    top = 2**63 - 1
    ranges = with_tokens(spark, [(1, 0, 0, 0, 5, 5), (1, 1, 0, 0, 0, top), (1, 2, 0, 0, 3, 99999999999999), (2, 0, 0, 0, top, top)])
    mentions = citations.first_mentions(ranges)
    pieces = {(r.doc_id, r.lo, r.hi, r.idx) for r in mentions.collect()}
    assert {p[3] for p in pieces} == {0, 1} and sum(hi - lo + 1 for d, lo, hi, _ in pieces if d == 1) == top + 1
    order = {r.doc_id: r for r in citations.citation_order(mentions).collect()}
    assert order[1].shown == "[5, 0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14]" and order[1].inversions == 1
    assert order[2].pairs == 0
    entries = spark.createDataFrame([(1, 3), (1, 99999999999999), (2, 1)], "doc_id long, number long")
    found = bibliography.citation_without_source(mentions, entries).select("description").collect()
    texts = {r.description for r in found}
    assert f"Ссылки [100000000000000-{top}] встречаются в тексте, но отсутствуют в списке источников." in texts
    assert f"Ссылка [{top}] встречается в тексте, но отсутствует в списке источников." in texts
    assert len(texts) == 8 and not any("[3]" in t for t in texts)


def test_long_range_expands_whole(spark):
    df = features.basic_features(manuscript(spark, ["[1-20000]"])).withColumn("in_title", F.lit(False))
    assert citations.citations(df).agg(F.count("*"), F.max("n")).first()[0:2] == (20000, 20000)


def test_glued_entries(spark):
    text = "1) Иванов И. Книга. М., 2001. 2) Петров П. Статья. 2002.\n3) Сидоров С. Труд. 2003."
    wrong = "4. Автор. Журнал. 2024. Т. 1. – М.: Наука"
    df = manuscript(spark, [text, wrong]).withColumn("stripped", F.col("text")).withColumn("numpr_num_id", F.lit(None).cast("int"))
    got = bibliography.bib_entries(df).orderBy("idx", "part_no").collect()
    assert [(r.idx, r.number) for r in got] == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_heading_pages_are_monotone(spark, blocks):
    pages = [(1, 1, "Содержание\nВведение"), (1, 2, "Введение\nтекст\n4"), (1, 3, "Метод\nВведение\n5"), (1, 4, "Итоги\nМетод\n6")]
    outline = [(1, 0, "Введение"), (1, 1, "Метод"), (1, 2, "Нет такого"), (1, 3, "Введение"), (1, 4, "Итоги")]
    got = revision.heading_pages(
        spark.createDataFrame(pages, "doc_id long, page_no int, text string"),
        spark.createDataFrame(outline, "doc_id long, idx int, text string"),
    )
    assert rows(got) == [(1, 0, 4), (1, 1, 5), (1, 2, None), (1, 3, 5), (1, 4, 6)]


def test_page_groups(spark, blocks):
    pages = [9, 9, None, 9, 10, 8, 11]
    df = spark.createDataFrame([(1, 0, i, p) for i, p in enumerate(pages)], "doc_id long, tbl_no int, row_no int, page int")
    got = tables.row_page_groups(df).orderBy("part").collect()
    assert [(r.on_page, r["rows"]) for r in got] == [(9, 3), (10, 2), (11, 1)]


def test_caption_numbers_restart_only_on_change(spark, blocks):
    caps = spark.createDataFrame([(1, i, None, "t", "x") for i in (1, 3, 5, 7, 9)], "doc_id long, idx int, original_number string, title string, text string")
    breaks = spark.createDataFrame([(1, 2, 1), (1, 4, 1), (1, 6, 2), (1, 8, 1)], "doc_id long, idx int, chapter long")
    got = captions.number_captions(caps, breaks).orderBy("idx").collect()
    assert [r.new_number for r in got] == ["1", "1.1", "1.2", "2.1", "1.1"]


def test_check_report_on_small_manuscripts(spark):
    body = "Длинный абзац основного текста с обсуждением метода и данных. " * 4
    messy = ["СОДЕРЖАНИЕ", "Введение ..... 3", "ВВЕДЕНИЕ", body + "[1][2]", "1 Анализ", body + "[7]", "3 Итоги", body,
             "СПИСОК ЛИТЕРАТУРЫ", "1. Автор А. Книга о методе, 2011.", "3. Автор Б. Без года"]
    clean = ["СОДЕРЖАНИЕ", "Введение ..... 3", "ВВЕДЕНИЕ", body + "[1]", "ЗАКЛЮЧЕНИЕ", body,
             "СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ", "1. Автор А. Книга о методе, 2011."]
    found = reports.check_report(reports.Manuscripts(manuscript(spark, messy, clean)), RULES)
    types = {(r.doc_id, r.type) for r in found.select("doc_id", "type").collect()}
    assert {(1, t) for t in ("citation_separator_missing", "citation_without_source", "bibliography_numbering_gap",
                             "bibliography_entry_incomplete", "missing_structural_section")} <= types
    assert not {t for d, t in types if d == 2} - {"volume_below_minimum"}
    assert {t for _, t in types} <= set(TYPE_CATEGORIES)


def test_large_groups_match_like_small_ones(spark, monkeypatch):
    rng = random.Random(5)
    detected, expected = (
        [(1, rng.choice(["placed", "mixed", "bibliography_missing"]), None if i % 7 == 0 else rng.randint(0, 9), i) for i in range(n)] for n in (60, 50)
    )
    schema = "doc_id long, type string, paragraph_index int, seq long"
    sides = [spark.createDataFrame(s, schema) for s in (detected, expected)]
    wanted = sorted(greedy(detected, expected), key=repr)
    for limit in (0, 64):
        monkeypatch.setattr(quality, "SMALL_GROUP", limit)
        got = quality.match_findings(*sides)
        assert rows(got.select("doc_id", "type", "exp_seq", "det_seq")) == wanted


def test_small_groups_need_no_rounds(spark, monkeypatch):
    schema = "doc_id long, type string, paragraph_index int, seq long"
    detected, expected = ([(d, "x", s % 3, 10 * d + s) for d in range(3) for s in range(n)] for n in (5, 4))
    monkeypatch.setattr(quality, "_match_placed", None)
    got = quality.match_findings(*[spark.createDataFrame(s, schema) for s in (detected, expected)])
    assert rows(got.select("doc_id", "type", "exp_seq", "det_seq")) == sorted(greedy(detected, expected), key=repr)


def test_pieces_of_lines_travel_without_their_text(spark):
    lines = spark.createDataFrame([(1, 1, 0, "введение"), (1, 2, 0, "")], "doc_id long, page_no int, line_no int, squashed string")
    entries = spark.createDataFrame([(1, 0, "введение", "введение")], "doc_id long, idx int, wanted string, _key string")
    pieces = revision._line_pieces(lines, entries)
    assert pieces.columns == ["doc_id", "page_no", "line_no", "_key"]
    assert "введение" in {r._key for r in pieces.collect()}



def _small_corpus(spark):
    texts = [
        "Содержание", "1 Первая глава ........ 3", "ВВЕДЕНИЕ", "1 Первая глава", "Текст, текст, текст и ещё текст. " * 5, "1.1 Раздел",
        "y = ax (1)", "", "где x — число", "2 Вторая глава:", "Итог:", "y = b", "3", "Глава 4. Итоги", "- пункт;", "2 Вторая глава", "ЗАКЛЮЧЕНИЕ",
        "Список литературы", "1. Автор А. А. Работа", "ПРИЛОЖЕНИЕ А", "Таблица 1 — Итоги",
    ]
    data = [
        (d, i, t, "center" if (d + i) % 3 == 0 else "left", (i * 3 % 11) / 10, "Heading 1" if (d + i) % 7 == 0 else "toc 1" if (d + i) % 11 == 0 else "Normal",
         14.0, (d + i) % 8 == 0, i % 2 if (d + i) % 5 == 0 else None, 4 if (d + i) % 5 == 0 else None)
        for d in range(1, 6) for i, t in enumerate(texts[d % 3:] + texts[: d % 3])
    ]
    columns = ("doc_id long, idx int, text string, alignment string, bold_ratio double, style_name string, modal_font_size_pt double, "
               "in_table boolean, numpr_ilvl int, numpr_num_id int")
    return features.stored(features.enrich(spark.createDataFrame(data, columns)), "small-corpus")


def test_headings_found_among_possible_ones_only_are_those_of_all_scores(spark):
    corpus = _small_corpus(spark)
    scored = features.stored(headings.score(corpus, RULES), "small-scores")
    wrong = scored.join(corpus.where(headings.own_reject(RULES)).select("doc_id", "idx"), ["doc_id", "idx"], "left_semi").where("reject IS NULL")
    assert wrong.count() == 0
    want = rows(headings.detect(scored))
    assert want and rows(headings.find(corpus, RULES, scored.select("doc_id", "idx", "in_title", "in_contents", "skip"))) == want


def test_formulas_take_zones_from_marks(spark, blocks):
    corpus = _small_corpus(spark)
    marks = corpus.select("doc_id", "idx", (F.col("idx") < 3 + F.col("doc_id")).alias("in_title"))
    heads = corpus.where("idx % 10 = 0").select("doc_id", "idx")
    want = rows(formulas.formulas(zones.with_marks(corpus, marks), heads))
    assert want and rows(formulas.formulas(corpus, heads, marks)) == want


def test_texts_are_stored_once_and_digests_stand_for_them(spark, monkeypatch):
    written = {}
    for module in (features, zones):
        kept = module.stage
        monkeypatch.setattr(module, "stage", lambda df, label, kept=kept: written.setdefault(label, kept(df, label)))
    corpus = _small_corpus(spark)
    zones.contents_lines(corpus, RULES)
    assert {"stripped", "norm"}.isdisjoint(written["small-corpus"].columns)
    assert [f.name for f in written["contents-rows"].schema if f.dataType.simpleString() == "string"] == []


def test_short_cuts_in_text_functions_change_nothing(spark):
    texts = ["a" + c + "b " + d for c in tx._WHITE for d in ("c", "", " c", c)] + ["a b", "", "İΣ ß", "abcdefghij", "ABCdefghij K", "Abcdefghijk", "АБВ", "1 ǅ", "a\nbc def ghij k"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.trim(tx.lower(F.regexp_replace(t, tx._WHITE_RUN, " ")))
    small = F.length(F.regexp_replace(t, r"\P{Ll}+", "")) >= 10
    upper = t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
    wrong = df.where((tx.norm_text(t) != plain) | (t.rlike(zones._TEN_SMALL) != small) | (tx.letters_all_upper(t) != upper))
    assert rows(wrong) == []


def test_guards_of_text_functions_change_nothing(spark):
    edges = [a + "x" + b for a in ("", " ", "​", " ", ".") for b in ("", "\t", "​ ", "7", "7. ")]
    texts = [*edges, "", " ", "Глава 1. Итоги", "ГЛАВА", "section IV Ends", "1.2) Раздел", "1", "1 ", "Ёж, ёлка — ѐђ №5/a`{", "\U0001f600 a😀b", "АБВ 1", "ABC", "Àß"]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    tail = F.right(F.rtrim(t, F.lit(tx._WHITE + ".")), F.lit(1)).rlike(r"(?U)\d")
    caps = ~t.rlike("[a-zа-яё]") & (tx.upper(t) == t) & (tx.lower(t) != t)
    squashed = F.trim(F.regexp_replace(tx.lower(F.coalesce(t, F.lit(""))), "[^0-9a-zа-яё]+", " "))
    same = [
        (tx.strip_blank(t), F.trim(t, F.lit(tx._EDGES))), (tx.ends_with_number(t), tail), (tx.is_all_caps(t), caps), (tx.squash_text(t), squashed),
    ]
    assert rows(df.where(tx.any_of([~a.eqNullSafe(b) for a, b in same]))) == []
    prefixes = {r.t: (r.p.kind, r.p.tokens, r.p.title) for r in df.select("t", tx.heading_prefix(t).alias("p")).collect() if r.p}
    assert prefixes == {
        "Глава 1. Итоги": ("chapter_word", [1], "Итоги"), "section IV Ends": ("chapter_word", [4], "Ends"), "1.2) Раздел": ("number", [1, 2], "Раздел"),
    }
    assert "[^0-9" not in str(tx.squash_text(t))


def test_names_are_looked_up_among_texts_of_few_words_only(spark):
    df = features.basic_features(spark.createDataFrame([(t,) for t in (" Список   литературы ", "введение", "введение в тему", "", None)], "text string"))
    names = ["список литературы", "введение"]
    assert rows(df.where(~tx.is_name(names).eqNullSafe(F.col("norm").isin(names))).select("text")) == []
    assert rows(df.where(tx.is_name([])).select("text")) == []


def test_captions_references_and_sections_take_zones_from_marks_and_move_no_texts(spark, blocks, monkeypatch):
    base = _small_corpus(spark)
    long = base.select(*base.columns).withColumn("text", F.when(F.col("idx") % 10 == 4, "см. рисунок 1, таблицы 2 и 3.1").otherwise(F.col("text")))
    layout = {"has_image": F.col("idx") % 9 == 3, "next_is_table": F.col("idx") % 2 == 0, "run_fonts": F.array(F.lit("courier new"))}
    given = long.select("doc_id", "idx", "text", "alignment", "bold_ratio", "style_name", "modal_font_size_pt", "in_table", *[v.alias(k) for k, v in layout.items()])
    extra = spark.createDataFrame([(1, 90, "Рисунок 1 — Схема", "left"), (1, 91, "Листинг 2 — Код", "left"), (1, 92, "def f(x):", "left"), (2, 0, "Рисунок 2 — Титул", "left")], "doc_id long, idx int, text string, alignment string")
    corpus = features.stored(features.enrich(given.where("NOT (doc_id = 2 AND idx = 0)").unionByName(extra, allowMissingColumns=True).fillna(False)), "caption-corpus")
    marks = corpus.select("doc_id", "idx", (F.col("idx") < F.col("doc_id") - 1).alias("in_title"))
    zoned = zones.with_marks(corpus, marks)
    for kind in captions.WORDS:
        want = rows(captions.caption_rows(zoned, kind))
        assert want and rows(captions.caption_rows(corpus, kind, marks=marks)) == want
    heads = corpus.where("idx % 5 = 2").select("doc_id", "idx", F.lit(1).alias("level"), F.col("stripped").alias("text"), F.lit("").alias("title_only"), F.lit("1").alias("derived_number"))
    shown = captions.all_captions(zoned, heads, RULES)
    want = rows(captions.text_references(zoned, shown))
    assert want and rows(captions.text_references(corpus, shown, marks)) == want
    hidden = spark.createDataFrame([(3, "содержание")], "doc_id long, norm string")
    want = rows(structure.section_positions(zoned, heads, hidden, RULES))
    scanned = []
    monkeypatch.setattr(structure, "scan", lambda df, *a, **k: (scanned.append(df), scan(df, *a, **k))[1])
    assert want and rows(structure.section_positions(corpus, heads, hidden, RULES, marks)) == want
    assert {r.norm for r in scanned[0].where("norm IS NOT NULL").select("norm").collect()} <= set(ru.aliases(RULES, *ru.CANONICAL_SECTIONS))


def test_source_list_starts_and_ends_as_by_the_plain_tests(spark):
    corpus = _small_corpus(spark).unionByName(
        features.stored(features.enrich(spark.createDataFrame([(8, 0, "НАША ЛИТЕРАТУРА"), (8, 1, "Библиография"), (9, 0, "итог"), (9, 1, None), (10, 3, "источники " + "и " * 60)], "doc_id long, idx int, text string")), "sources-corpus"),
        allowMissingColumns=True,
    )
    heads = corpus.where("idx % 4 = 1").select("doc_id", "idx")
    stems = (F.length("norm") < 80) & tx.any_of([F.col("norm").contains(s) for s in zones.SOURCE_STEMS])
    starts = corpus.where(~F.col("is_empty") & (F.col("norm").isin(ru.aliases(RULES, "references")) | stems)).groupBy("doc_id").agg(F.min("idx").alias("at"))
    ends = heads.join(starts, "doc_id").where("idx > at").groupBy("doc_id").agg(F.min("idx").alias("end"))
    want = rows(starts.join(ends, "doc_id", "left").select("doc_id", F.col("at") + 1, "end"))
    got = zones.references_range(corpus, heads, RULES)
    assert {r[0] for r in want} >= {1, 8} and rows(got) == want


def test_pieces_that_are_no_key_of_their_manuscript_stay(spark):
    text = " ".join(f"слово{i}" for i in range(40))
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["введение", *(text[k : k + 20] for k in range(200))])], "doc_id long, page_no int, line_no int, squashed string")
    entries = spark.createDataFrame([(1, 0, "введение", "введение"), (1, 1, text[7:40], text[7:19])], "doc_id long, idx int, wanted string, _key string")
    keys = [r._key for r in revision._line_pieces(lines, entries).collect()]
    assert "введение" in keys and text[7:19] in keys and len(keys) < 40


def test_blanks_and_appendix_titles_are_found_without_moving_texts(spark, blocks, monkeypatch):
    corpus = _small_corpus(spark).withColumn("elem_no", F.col("idx") + F.when(F.col("idx") > 6, 1).otherwise(0)).withColumn("in_title", F.lit(False))
    corpus = corpus.withColumn("has_image", F.lit(False)).withColumn("has_section_break", F.lit(False))
    scanned = []
    monkeypatch.setattr(revision, "scan", lambda df, *a, **k: (scanned.append(df.columns), scan(df, *a, **k))[1])
    left = corpus.where("NOT is_empty OR idx = 7").select("doc_id", "idx", "text").collect()
    want = []
    for d in {r.doc_id for r in left}:
        want += [(d, n, r.idx, r.text) for n, r in enumerate(sorted((r for r in left if r.doc_id == d), key=lambda r: r.idx))]
    assert rows(revision.drop_empty_paragraphs(corpus).select("doc_id", "idx", "old_idx", "text")) == sorted(want, key=repr)
    titles = {(r.doc_id, r.new_text) for r in revision.appendix_title_rows(corpus).collect()}
    assert titles and all(text == "Таблица 1 — Итоги" for _, text in titles)
    assert not {"text", "stripped"} & {c for columns in scanned for c in columns}
