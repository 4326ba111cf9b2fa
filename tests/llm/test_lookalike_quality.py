import random

import pytest

from prosescan.llm import lookalike, quality

REFS = [("r1", "half-covered angles"), ("r2", "naïve reading of the ledger"), ("r3", "naive reading of the ledger"), ("r4", "预算版PPT式日程"), ("r5", "between X and the bolt"), ("r6", "First order, then welcome")]
SAME = [
    ("r1", "hаlf-cοvered anglеs"), ("r1", "half­covered angles".replace("­", "-​")), ("r1", "half‐covered angles"), ("r1", "ｈａｌｆ－ｃｏｖｅｒｅｄ　ａｎｇｌｅｓ"), ("r1", "hal͏f-ϲovered angⅼes"),
    ("r2", "naïve reading of the ledger"), ("r2", "nаїvе rеаdіng оf thе lеdgеr"), ("r4", "预算版РРТ式⽇程"), ("r5", "bеtwееn Χ аnd thе bоlt"), ("r5", "between Х and the bolt"), ("r6", "ﬁrst".replace("ﬁ", "Fi") + " order, then wеⅼсοmе"),
]
OTHER = ["half-covered angles!", "Half-covered angles", "half covered angles", "halfcovered angles", "half-covered  angles", "половина", "проверка текста", "καθαρή φράση", "👩‍💻 notes", "", None, "naïvé reading of the ledger", "between X and the bo1t"]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(REFS, "lex_id string, phrase string")


def test_matches(spark, refs):
    texts = [t for _, t in SAME] + [t for _, t in REFS] + OTHER + ["x" * 100_000 + "а"] + [SAME[0][1]] * 2
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "phrase_id long, text string, form string, ref_id string")
    got = sorted(tuple(r) for r in lookalike.look_alike_matches(df, "phrase_id", "text", refs, "lex_id", "phrase").collect())
    assert got == sorted([(i, r) for i, (r, _) in enumerate(SAME)] + [(len(texts) - k, "r1") for k in (1, 2)])
    assert lookalike.look_alike_matches(df.limit(0), "phrase_id", "text", refs, "lex_id", "phrase").count() == 0
    assert lookalike.look_alike_matches(df, "phrase_id", "text", refs.limit(0), "lex_id", "phrase").count() == 0


@pytest.mark.parametrize("text", ["проверка текста", "сухая оговорка в начале", "καθαρή φράση", "câu văn trống rỗng", "žluťoučký odstavec", "سطر فارغ", "言い換えるなら", "👩‍💻 notes", "x² and ½", "größere Floskel", "λx and 5μm"])
def test_lawful_text_stays(refs, text):
    assert lookalike.Reader(lookalike.letter_bigrams(refs, "phrase")).read(text) == text


def test_random_replacements_are_read_back(refs):
    reader, rng = lookalike.Reader(lookalike.letter_bigrams(refs, "phrase")), random.Random(9)
    twins = {}
    for char, readings in lookalike.READINGS.items():
        if not char.isascii():
            for c in readings:
                if c.isascii():
                    twins.setdefault(c, []).append(char)
    for _ in range(200):
        _, text = rng.choice(REFS)
        assert reader.read("".join(rng.choice(twins[c]) if c in twins and rng.random() < 0.6 else c for c in text)) == text


def test_bigrams_of_other_scripts_read_their_words_back(spark):
    clean = ["сухая оговорка в начале строки", "проверка текста и поиск слова", "κάθε καθαρή φράση πρέπει να μένει"]
    reader = lookalike.Reader(lookalike.letter_bigrams(spark.createDataFrame([(t,) for t in clean], "t string"), "t"))
    assert {"CYRILLIC", "GREEK"} <= reader.known
    # Latin and Greek letters in Cyrillic words, Latin and Cyrillic ones in Greek words
    for text, dressed in ((clean[0], clean[0].translate(str.maketrans("аоср", "aοcp"))), (clean[1], clean[1].translate(str.maketrans("екх", "eκx"))), (clean[2], clean[2].translate(str.maketrans("κνο", "кvo")))):
        assert dressed != text and reader.read(dressed) == reader.read(text) == text


@pytest.mark.parametrize(("text", "shape"), [
    ("• one\n• two\n• three\n• four", "list"), ("Title\n1. a b\n2. c d\n\n3. e f\n4. g h", "list"), ("[x] a\n[ ] b\n[x] c\n[ ] d", "list"), ("一、甲\n二、乙\n三、丙\n四、丁", "list"), ("a) x\r\nb) y\r\nc) z\r\nd) w", "list"),
    ("• one\n• two\n• three", None), ("**No** yard.\n**No** lamp.\n**No** rope.\n**No** sea.", None), ("3.14 is pi.\n3.14 is pi.\n3.14 is pi.\n3.14 is pi.", None),
    ("a,b,c\n1,,3\n4,5,6\nx,n/a,z", "table"), ("| a | b | c |\n| --- | --- | --- |\n| 1 | | 3 |\n| 4 | 5 | 6 |", "table"), ("a\tb\tc\n1\t\t\n2\t3\t\n4\t5\t6", "table"), ("aa   bb   cc\n1    2    3\n4    5    6\n7    8    9", "table"),
    ("lamp,rope,sea\nold,new\nfour,five,six,ten\nred,blue", None), ("First, we met, and left.\nThen, he ran, and fell.\nNow, she sat, and read.\nLast, it rained, and poured.", None),
    ("candle, " * 40, "junk"), ("rope" * 30, "junk"), ("=" * 80, "junk"), ("哈" * 60, "junk"), ("0941 ae3a d22b dbc5 fdd0 a9c9 a51c 6568", "junk"), ("$=+&#^&@*!% @-#<$+^=?>!%._!=%*/%<%", "junk"), ("xctxatlwwdke bvvsarjahxxk fje ced evjez dgzqa kvcahcx", "junk"), ("æ\x80»å\x85±67ä»½ç\x9b®å½\x95ï¼\x8cæ\x99¾æ\x99\x92", "junk"),
    ("HE SAID THAT THE LAMP WAS OUT AND LEFT.", None), ("Yeah\nYeah\nYeah", None), ("哈哈，今天57点见吧", None), ("", None), (None, None), (" \n\t", None), ("проверка текста в начале строки", None), ("Théré is oné damp notice left.", None),
])
def test_shapes(text, shape):
    assert quality.Partial(text or "").finished()["shape"] == shape


def test_chunks_give_what_the_whole_text_gives(spark):
    rng = random.Random(11)
    pieces = ["word ", "Ünïcode ", "两个字", "。", "\r\n", "\n", "\r", "- item\n", "a | b | c\n", "  ", "x1y ", "!!! ", " ", "end.", "'", "😂", "a,b,c\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 120))) for _ in range(150)]
    for text in texts:
        whole = quality.Partial(text).finished()
        for size in (1, 5, 17):
            parts = [quality.Partial(text[i : i + size]) for i in range(0, len(text), size)]
            # merged as a tree: pairs of neighbours, level by level
            while len(parts) > 1:
                parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            assert parts[0].finished() == whole, (size, text)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, None, "", "w " * 9000])], "doc_id long, text string, n string")
    rows = [{tuple(r) for r in quality.text_statistics(df, "doc_id", "text", chunk, fan).collect()} for chunk, fan in ((16_384, 64), (13, 2), (13, 64))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 153
    assert quality.text_statistics(df.limit(0), "doc_id", "text").count() == 0


def test_long_runs_and_hard_shares_are_exact_in_chunks():
    filler = [f"{a}{b}an" for a in "bcdfghklmnprst" for b in "aeiou"]
    texts = ["a" * 20_000, "x " + "b1" * 150 + "\n" + "哈" * 300 + "abc" * 90 + " end", "中" * 40 + "w" * 40 + "文" * 40, " " * 200 + "- item\n" + (" " * 150 + "1. two\n") * 5]
    # a word at a share of 0.75 of all letters, a little more and a little less
    for k in (-2, 0, 2):
        texts.append(" ".join(["rope"] * (3000 + k) + (filler * 20)[:1000]))
    for text in texts:
        whole = quality.Partial(text).finished()
        for size in (13, 97, 4096):
            parts = [quality.Partial(text[i : i + size]) for i in range(0, len(text), size)]
            while len(parts) > 1:
                parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            assert parts[0].finished() == whole, (size, text[:40])
    assert quality.Partial("a" * 20_000).finished()["n_words"] == 1
    assert [quality.Partial(t).finished()["shape"] for t in texts[3:]] == ["list", None, "junk", "junk"]


def test_deeply_indented_items_are_seen():
    from prosescan.llm import quality

    text = " " * 130 + "\t-  item of the list"
    whole = quality.Partial("\n".join([text] * 4))
    line = quality.Line(text)
    for cut in range(len(text) + 1):
        line = quality.Line(text[:cut]).joined(quality.Line(text[cut:]))
        assert line.opening == "-  item of the list"
    line.add_to(whole)
    assert whole.n_items >= 1 and not whole.rows
