"""Sentence units of texts in many scripts."""

import pytest
from weftline.llm import dictionary, segment, sentences

CASES = {
    "abbreviations": ["Ask Dr. Ellimar or Prof. T. K. Tembry about Fig. 3.", "It reads the file, etc. before it stops, e.g. at No. 5 (cf. the grid, p. 72).", "We restarted it at 4 a.m.", "The run ended at 9 p.m. on the node."],
    "numbers": ["I set it to 3,339.25 and to .37, but version 2.5.7 fails.", "34 of the 272 chunks were second.", "Really?!", "Set io.limit = 2.5 in psl_day.tar.gz."],
    "quotes": ['The log says "Remote slice. Session?" and then stops.', '"Does it still work?" asked the next user.', 'My colleague said: "The buffer drops the step."', "The axis (see above) stops.", "(The index doubles it.)", 'Is "fast cell!" known?'],
    "dots": ["So it repeats... but only silently.", "Hmm...", "cdcat keeps the replica at 70.6%.", "It reads it."],
    "code spans": ["Call `find_step(x.units, n=1.5). Next` first.", "What about `ds.to_box`, does it work?", "See https://a.b.example/q?id=2.Next#top or http://c.example/x.nc.", "Good."],
    "german": ["Am 3. März kürzt sie zum 29. Mal die Kopie.", "Das gilt z. B. für die Kopie bzw. die Kennung, d. h. alles.", "Im Protokoll steht: „Keine Liste. Abbruch!“ und sonst nichts.", "„Warum?“, fragte der Nächste.", "Siehe Abs. 25."],
    "french": ["Le message « Pas de archive. Fin ! » revient.", "Merci !", "« Pourquoi ? » demande le suivant.", "La somme coupe tout : bornes, etc.", "M. Orvane dit non."],
    "spanish": ["¿Por qué?", "El aviso «Sin fila. Fin.» sale cada noche.", "La Sra. Imbrel, p. ej., usa la fig. 7.", "¡Gracias!"],
    "russian": ["«Почему?» — спросил другой.", "Шаг и т. д. портит строка, т. е. копия.", "В 2014 г. граница ещё работала.", "А. Б. Ормунд пишет."],
    "greek": ["Γιατί η λίστα χάνει τα βήματα;", "Βλ. σελ. 4, π.χ. τιμές κ.λπ.", "Ευχαριστώ!", "Ο κ. Ορμάν λέει."],
    "arabic": ["لماذا تكرر الخلية هذه السجلات؟", "يرى د. ورمالين أن الحدود تفقد الوحدة.", 'يقول السجل: "لا توجد النسخة. توقف!" ثم ينتهي.', "شكرا!"],
    "hindi": ["डॉ. वेलमार कहते हैं।", 'लॉग में "अक्ष नहीं। रुकें!" लिखा है।', "मेरे यहाँ है॥", "पृ. 26 पर देखें।"],
}


@pytest.mark.parametrize("name", CASES)
def test_spaced_scripts(name):
    for gap in (" ", "  ", "\n"):
        text = gap.join(CASES[name])
        assert [text[s:e] for s, e in segment.units(text)] == CASES[name]


@pytest.mark.parametrize(
    "parts",
    [
        ["値は24.27で、1.5ではありません。", "「なぜ？」と次の人が書きました。", "（ファイルは境界を忘れます。）", "わかりません…。", "『入門』の12頁を見てください。"],
        ["他说：“掩码重复了副本。”", "“为什么？”下一个人问。", "日志里写着“没有单元。停止！”然后就结束了。", "不知道……", "参见https://a.example/a.b?x=1 的说明。"],
    ],
)
def test_scripts_without_blanks(parts):
    text = "".join(parts)
    assert [text[s:e] for s, e in segment.units(text)] == parts


def test_thai():
    parts = ["พอใช้พิกัด ก็ข้ามขอบเขตทันทีเลยค่ะ", "ขอบคุณค่ะ", "ค่าเป็น 2.87 ไม่ใช่ 6.1 ค่ะ", "กริด (รุ่น 5.1) ตัดตัวแปรครับ", "ผมลองกับแฟ้ม ตัวแปร และค่าอื่นๆ แล้วครับ", "แฟ้มต่างๆตัดตารางไหม"]
    for gap in (" ", "\n"):
        text = gap.join(parts)
        assert [text[s:e] for s, e in segment.units(text)] == parts
    assert segment.Words(["กริด", "ตัด", "แฟ้ม"]).split("ทำไมกริดตัดแฟ้มครับ") == ("ทำไม", "กริด", "ตัด", "แฟ้ม", "ครับ")


def test_blocks():
    text = "How to merge a grid\n\nIntro one. Two\ncontinues here\n\n```sh\na. B\n\nc? D\n```\n\n    x = 1. Y\n    z\n\n- One. Two.\n- `c` three\n1. First\n2. Second! Third\n\n> Quote one. Two\n\nhttps://a.example/x?y\n\n<pre><code>a. B\n\nC</code></pre>\nLast without mark"
    got = [text[s:e] for s, e in segment.units(text)]
    assert got == [
        "How to merge a grid", "Intro one.", "Two\ncontinues here", "```sh\na. B\n\nc? D\n```", "x = 1. Y\n    z", "- One.", "Two.", "- `c` three", "1. First", "2. Second!", "Third",
        "> Quote one.", "Two", "https://a.example/x?y", "<pre><code>a. B\n\nC</code></pre>", "Last without mark",
    ]


def test_wrapped_line_that_begins_with_a_number():
    text = "Sie kürzt zum\n1. Mal die Kopie. Am\n3. März nicht."
    assert [text[s:e] for s, e in segment.units(text)] == ["Sie kürzt zum\n1. Mal die Kopie.", "Am\n3. März nicht."]


def test_missing_blanks_and_odd_texts():
    text = "It stops.The next one. Use psl_day.tar.gz or x.Y here.(Yes it does.) No"
    assert [text[s:e] for s, e in segment.units(text)][:2] == ["It stops.", "The next one."]
    for text in ("", None, "  \n\t ", "```", "`", '"', "(((", "...", "\n".join(["a"] * 5), "x" * 100_000, "「」。" * 1000, "~~~\nopen. Fence"):
        for s, e in segment.units(text):
            assert text[s:e].strip() == text[s:e] != ""


def test_every_character_is_in_one_unit(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    units = {}
    for r in sentences.sentence_units(documents).collect():
        units.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    for r in documents.collect():
        text, held = r["text"] or "", [0] * len(r["text"] or "")
        for s, e in units.get(r["doc_id"], []):
            assert s < e <= len(text) and text[s:e] == text[s:e].strip()
            for k in range(s, e):
                held[k] += 1
        assert all(n == 1 for n, c in zip(held, text) if not c.isspace())


def test_operator_edges(spark):
    rows = [(1, "A b. C d.", "x", 1), (1, "A b. C d.", "x", 1), (2, None, "x", 1), (3, "  ", "x", 1), (None, "A.", "x", 1), (4, "wort " * 50_000 + "Ende.", None, None), (5, "😀 one. Two 😀.", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_pos string, _key int")
    got = [tuple(r) for r in sentences.sentence_units(df).orderBy("doc_id", "start_pos").collect()]
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 250_005), (5, 0, 6), (5, 7, 13)]
    assert sentences.sentence_units(df.limit(0)).count() == 0
    assert {r["sentence"] for r in sentences.sentences(df.where("doc_id = 5")).collect()} == {"😀 one.", "Two 😀."}


#: Sentences that are not in the style of the test documents.
HELD_OUT = [
    ["Lt. Smith arrived late.", "Pres. Lee did not wait for him!", "Sig. Rossi paid 3.50 euros, i.e. half."],
    ["The U.S. team won 3.5 to 2.", "Nobody, not even Prof. J. Carter, saw it coming.", '"Are you sure?" she asked.', "He was."],
    ["Der Zug kam am 24. Dezember an.", "Niemand wartete, z. B. weil es schneite.", "Warum?"],
    ["Elle dit : « Je pars. Adieu ! » et ferme la porte.", "Il ne répond pas…", "Fin."],
    ["今日は雨が降っています。", "「もう帰りますか？」と彼は聞いた。", "はい！"],
    ["他昨天去了北京。", "“你好！”她说。", "天气很好，我们去公园吧。"],
    ["Он родился в 1950 г. в Москве.", "Потом, т. е. через год, уехал.", "Почему?"],
]


@pytest.mark.parametrize("parts", HELD_OUT)
def test_held_out_sentences(parts):
    text = ("" if ord(parts[0][0]) > 0x3000 else " ").join(parts)
    assert [text[s:e] for s, e in segment.units(text)] == parts


def test_held_out_thai(spark):
    words = dictionary.thai(spark)
    if not words:
        pytest.skip("a Java runtime without its Thai dictionary")
    lexicon = segment.Words(words)
    assert lexicon.split("วันนี้อากาศดีมาก") == ("วันนี้", "อากาศ", "ดี", "มาก") and len(words) > 20_000
    for parts in (["วันนี้อากาศดีมาก", "เราไปเที่ยวทะเลกัน", "พรุ่งนี้ฝนจะตก"], ["ร้านเปิดกี่โมงคะ", "ร้านเปิดเก้าโมง แล้วปิดห้าโมงครับ"], ["นักกีฬาชนะ การแข่งขันครั้งนี้"]):
        text = " ".join(parts)
        assert [text[s:e] for s, e in segment.units(text, lexicon)] == parts


def test_other_scripts_without_spaces():
    for parts in (["ສະບາຍດີ ເຈົ້າໄປໃສບໍ", "ຂ້ອຍໄປຕະຫຼາດ"], ["តើអ្នកទៅណា", "អរគុណ"], ["သူ သွားတယ်", "ကျေးဇူး"]):
        text = " ".join(parts)
        got = [text[s:e] for s, e in segment.units(text)]
        assert "".join("".join(got).split()) == "".join(text.split()) and len(got) >= 2


def test_cheapest_path_is_global():
    """A bracket that opens a sentence ends it; the same bracket within one doesn't."""
    for parts in (["(He left. She stayed.) Then it rained.", ], ["It rained (he left. She stayed) and stopped.", "Good."]):
        text = " ".join(parts)
        got = [text[s:e] for s, e in segment.units(text)]
        assert got == (["(He left. She stayed.)", "Then it rained."] if text[0] == "(" else parts)


@pytest.mark.parametrize("pattern", ["ก (ข) ", "<pre> a. ", "<pre ", "(", "a.b.", '"a. ', "`", "((]", "1. ", "»«.", "A. B. "])
def test_time_grows_with_the_text(pattern):
    import time

    def seconds(n):
        text = pattern * n + "]" * n
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            segment.units(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(16_000) < 9 * seconds(4_000) + 0.05


def test_dictionary_of_a_file(tmp_path):
    (tmp_path / "words.txt").write_text("กริด\n\n แฟ้ม\t7\n", encoding="utf-8")
    assert dictionary.from_file(f"{tmp_path}/words.txt") == {"กริด", "แฟ้ม"}


@pytest.mark.parametrize("fault", ["missing", "another form", "no words"])
def test_unreadable_dictionary_is_no_result(spark, monkeypatch, fault):
    text = "นักกีฬาชนะ การแข่งขันครั้งนี้"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    if fault == "missing":
        monkeypatch.setattr(dictionary, "_RESOURCE", "/modules/jdk.localedata/none")
    elif fault == "another form":
        monkeypatch.setattr(dictionary, "_RESOURCE", "/modules/java.base/java/lang/Object.class")
    else:
        monkeypatch.setattr(dictionary, "_words", lambda data: [])
    dictionary._runtime.cache_clear()
    try:
        with pytest.raises(RuntimeError, match="Thai dictionary"):
            sentences.sentence_units(df)
        assert sentences.sentence_units(df, words=["นักกีฬา", "ชนะ", "การแข่งขัน", "ครั้ง", "นี้"]).count() == 1
        assert sentences.sentence_units(df, words=[]).count() == 2
    finally:
        dictionary._runtime.cache_clear()
