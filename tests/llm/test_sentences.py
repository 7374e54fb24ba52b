import pytest

from conftest import rows
from depweft.llm import sentences as k


def units(text, lang=None):
    out, at = [], 0
    for e in k.unit_ends(text, lang):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "lang, text, count",
    [
        ("en", "Ask Dr. Korlusen or Ms. Vor about it. It rose to 1.5 sec. on the host within approx. 30 min. of load. Done.", 3),
        ("en", "We checked hosts, ports, etc. Since then it runs v. 4.10.4 now. See no. 12, i.e. the copy.", 3),
        ("en", "It was 9 a.m. in the room. J. Yas and A. B. Mir signed off. The U.S. cluster runs.", 3),
        ("en", "The log said “Lost the lease. Retrying in 75.04 s.” and then went quiet. The end.", 2),
        ("en", 'The note read: "Do not restart it!" Since then it waits... and waits. It stopped... Then it ran.', 4),
        ("en", "The change (see a.config. Both copies.) went out. (The rule was never merged.) Next?! Yes.", 4),
        ("en", "Set x to .5, not to 5.0, in a.b.yml. Call https://h.test/x?y=1.5 and read it.", 2),
        ("en", "the answer is 955. assume nine. ASK APPROX. THIRTY MIN. OF LOAD. THEN STOP.", 4),
        ("de", "Der Wert gilt d. h. nur für Adam, z. B. Berta. Am 3. Oktober kam es. Siehe Abschn. 60 ff. in Cäsar. „Nicht anfassen. Erst fragen!“ stand da.", 4),
        ("fr", "Voir art. 337, etc. Le seuil passe à 2,75 s env. pour A. « Ne touchez à rien. Appelez B ! » disait le fichier. M. Korj et Mme Grin lisent\n?", 4),
        ("es", "El Sr. A y la Dra. B leen. El límite es 1.250,75 EE. UU. para C. ¿Y ahora? Véase la pág. 10, p. ej. la nota.", 4),
        ("ru", "Проверьте, т. е. сравните, 3,5 сек. для Алис. См. рис. 5 и т. д. А. Б. Гор отвечает. «Не трогать. Сначала спросить!» стояло там.", 4),
        ("el", "Διαβάζει το A; Στη φάση beta. Δείτε π.χ. τη σελ. 4. Το όριο έγινε 3,5 δευτ. για το C.", 4),
        ("ar", "هل تقرأ A حقا؟ قال د. Kor إن B بخير. كان فارغا.", 3),
        ("hi", "डॉ. Kor ने A को देखा। क्या B पढ़ता है? मत रोको!", 3),
        ("th", "กฎข้อ 99 ยังอ่านรุ่น 1.2 ของ A แล้ว อย่าเพิ่งหยุด B ตอนนี้ ควรตรวจ", 3),
        ("zh", "日志里写着“租约丢失。正在重试A。”然后就停了。为什么是空的？！（规则没有合并。）等一下……B又回来了。", 4),
        ("ja", "記録には「接続が切れた。Aを再試行する。」とあった。Bを読みますか？待って…Cが戻った。", 3),
    ],
)
def test_languages(lang, text, count):
    assert len(units(text, lang)) == count, units(text, lang)
    assert len(units(text, None)) == count, "the label is not needed"


def test_lines_of_their_own():
    text = (
        "# Title. With stop\nProse goes\non here. Twice.\n\n- One. Two.\n- Three\n1) Four. Five\n\n2026-01-02 03:04:05.678 WARN A is empty. Using default\n"
        "export A.B='x. y'\nA.B.C: 1.5\nA.B=2\n[12:30] me: hi. there.\nSummary"
    )
    assert units(text) == [
        "# Title. With stop", "Prose goes\non here.", "Twice.", "- One. Two.", "- Three", "1) Four. Five", "2026-01-02 03:04:05.678 WARN A is empty. Using default",
        "export A.B='x. y'", "A.B.C: 1.5", "A.B=2", "[12:30] me: hi. there.", "Summary",
    ]


def test_places_and_small_cases():
    assert k.unit_ends("Hi there!  \r\n\r\n  Yes. ") == [9, 21]
    assert k.unit_ends("One. 👍\n\nTwo") == [6, 11]
    assert k.unit_ends("") == [] and k.unit_ends(" \n\t\n ") == []
    assert k.unit_ends("no mark at all") == [14]
    assert k.unit_ends("Am\n3. Oktober kam es. Gut.", "de") == [21, 26]
    assert len(k.unit_ends("Word. " * 100_000)) == 100_000
    for hostile in ("." * 50_000 + "a", "(a " * 50_000, "“" * 50_000, "。" * 50_000, "a" * 500_000, "(" * 20_000 + ")" * 20_000):
        assert k.unit_ends(hostile)


def test_first_rule_decides():
    cascade = k.cascade_for("text", "en")
    assert cascade.rules[-1] is k.TABLES["common"][-1]
    assert not cascade.decides("See no. 5", 0, 7) and cascade.decides("He said no. Then", 0, 11)


def test_frames(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", "x"), (2, None, None, "x"), (3, " ", "en", "x"), (1, "A b. C d.", "en", "x")], "doc_id bigint, text string, lang string, end_pos string")
    assert rows(k.sentence_units(df)) == [(1, 4), (1, 4), (1, 9), (1, 9)]
    assert rows(k.sentence_units(df.limit(0))) == []


def test_script_by_share_of_letters():
    text = "The α value is set; then restart the node. It works."
    assert k.unit_ends(text, "en") == [42, 52], "one Greek letter does not make a semicolon a question mark"
    assert k.unit_ends("Πού είναι το αρχείο config; Εδώ.", "en") == [27, 32]
    assert k.unit_ends("The title 東 stays. So does の here. End.", "en") == [18, 34, 39]
    assert k.unit_ends("请重启 prometheus-exporter 服务。完成。", None) == [27, 30]
