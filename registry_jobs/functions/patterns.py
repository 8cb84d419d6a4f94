"""Character classes, words, patterns and replacement rules. All are valid in Java and in RE2,
unless a name ends in _JAVA (look-around)."""

from __future__ import annotations

#: White space as ECMAScript's \s has it, as one class without brackets.
WS_CHARS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CHARS}]"
#: The characters of WS themselves.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
JAPANESE_CHARS = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}々〆ヶ"
JAPANESE = f"[{JAPANESE_CHARS}]"
KANJI_KANA_CHARS = "一-龠ぁ-んァ-ン"
JOINED_CHARS = KANJI_KANA_CHARS + "ー々〆ヶ"
ALNUM = "[A-Za-z0-9]"
SYMBOL = f"[^A-Za-z0-9{JAPANESE_CHARS}{WS_CHARS}]"
WORD4_JAVA = "(?<![0-9A-Za-z_])[A-Za-z]{4,}(?![0-9A-Za-z_])"
_SOLID = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}0-9A-Za-z.,:㎡/"
#: Values that cleaning leaves as they are: words of letters, digits and a few signs with single blanks between, no mark in front.
CLEAN_JAVA = rf"^(?![・:])[{_SOLID}]++(?: [{_SOLID}]++)*+\z"
#: Values with Japanese and but digits and a few signs beside it.
PLAIN_JAVA = rf"^[0-9 .:/㎡]*+[{KANJI_KANA_CHARS}][{KANJI_KANA_CHARS}0-9 .:/㎡]*+\z"
CAPITALS_OR_WORD5_JAVA = "[A-Z]{4,}|(?<![0-9A-Za-z_])[a-z]{5,}(?![0-9A-Za-z_])"

# Section and label words.
TITLE_LABELS = ("所在", "地番", "地積", "床面積", "建物面積")
OTHER_LABELS = ("地図番号", "地目", "種類", "構造")
SECTION_WORDS = ("権利部", "甲区", "乙区", "共同担保目録", "共同担保", "担保目録")
NOT_DETECTED = "未検出"
COOWNERS = "共有者候補あり"
BUILDER = "アーネストワン"
EXCLUDED_RIGHTS = "乙区|抵当権|抵当権設定|共同担保目録|共同担保|担保目録|金銭消費貸借|連帯債務者|抵当権者"
HEADER = "登記の目的|受付年月日|受付番号|権利者その他事項|順位番号.*登記の目的|遷委番号.*登記の目的|権利者その他|能利者その他"
CONTAMINATION = "所有権保存|所有権移転|所有権|原因|受付|順位番号|権利部|甲区|乙区|表題部|地積|床面積|権利者|所有者|共同担保|担保目録|抵当権"
NOISE_TOKENS = "[%@]|ーー|--|B2548|んかも|床攻会社|遷委番号|WESS|Mow|BRd Ana|2th22"
CORPORATION = "株式会社|有限会社|合同会社|一般社団法人|財団法人|医療法人|学校法人|銀行|信託|組合|公社|協同組合"
PERSON = f"[{KANJI_KANA_CHARS}]{{2,}}"
NOT_PERSON = "^(順位|受付|原因|登記|住所|持分|甲区|乙区|権利部)"
ADDRESS = "[都道府県市区町村].*(丁目|番地|番)"
LOCATION_REJECT = "の土地|土地本|持分|共有者|番地|丁目[0-9一二三四五六七八九十]+番|共同担保|抵当権"
OWNER_DATES = "[0-9]+年[0-9]+月[0-9]+日|令和|平成|昭和|/|／"
OWNER_EVENTS = "登記の目的|受付年月日|受付番号|順位番号|権利者その他|原因|売買|所有権移転|所有権一部移転|持分一部移転|抵当権|共同担保"


def _shortest(*patterns: str) -> str:
    """All alternatives of the patterns but those which hold another: where these match, the other does."""
    words = list(dict.fromkeys(w for p in patterns for w in p.split("|")))
    return "|".join(w for w in words if not any(o != w and o in w for o in words))


#: What no owner holds: a header, other fields' words, an address, noise, dates and events, in one pattern.
OWNER_REJECT = _shortest(HEADER, CONTAMINATION, NOISE_TOKENS, "OCR候補", OWNER_DATES, OWNER_EVENTS) + f"|{ADDRESS}"
LOT_NUMBER = r"[0-9]{1,5}番[0-9\-]{0,8}|[0-9]{1,5}-[0-9]{1,5}|[0-9]{1,5}"
LOT_NUMBER_MARKED = r"[0-9]{1,5}番[0-9\-]{0,8}|[0-9]{1,5}-[0-9]{1,5}"
TITLE_START = "表題部|土地の表示|所在|地番|地積"
TITLE_STOP = "甲区|乙区|共同担保目録|抵当権"
COLLATERAL = "共同担保目録|共同担保|担保目録"
LAND_WORDS = "地番|表題部|所在|地積|土地"
EVENT_WORDS = "所有権|移転|相続|売買|贈与|抹消|変更|更正|仮登記"
OWNERSHIP_WORDS = "所有権|移転|売買|相続|贈与"
INVALID_WORDS = "抹消|仮登記|変更|更正"
HISTORY_WORDS = "所有権|所有者|権利者|共有者|原因|売買|相続|贈与|受付|第[0-9]+号"
NUMBER_CONTEXT = "地番|受付|順位番号|第|号|持分|分の|番地|地積|床面積|建物面積"
HISTORY_NOISE = r"^[A-Za-z0-9" + WS_CHARS + r"]+\z|^[0-9/:.\-" + WS_CHARS + r"]+\z|^第?[0-9]+号?\z|^受付" + WS + r"*第?[0-9]+号?\z"
HISTORY_REJECT = _shortest(HEADER, EXCLUDED_RIGHTS, NOISE_TOKENS) + f"|{HISTORY_NOISE}"
LIKELY_HISTORY_NOISE = r"WESS|Mow|BRd Ana|2th22|抵当権|共同担保|担保目録|^[A-Za-z0-9" + WS_CHARS + r"]{4,}\z"

# What a confirmed value may not hold, and what it must be.
DANGEROUS = "登記の目的|受付年月日|受付番号|順位番号|遷委番号|権利者その他|原因|売買|所有権移転|所有権一部移転|持分一部移転|抵当権|共同担保|担保目録|[%@|｜]|ーー|B2548|んかも|床攻会社"
CONFIRMED_CORPORATION = "株式会社|有限会社|合同会社|一般社団法人|財団法人|医療法人|学校法人"
CONFIRMED_NUMBER = r"^[0-9]{1,5}(?:番[0-9-]{0,8}|-[0-9]{1,5})\z"
CONFIRMED_AREA = r"^[0-9]+(?:\.[0-9]+)?㎡\z"
CONFIRMED_LOCATION_REJECT = "丁目[0-9一二三四五六七八九十]+番|番地|の土地|土地本|持分|共有者"
CONFIRMED_NUMBER_REJECT = "番地|丁目|所有者|共有者|権利者|抵当権|債務者"

# Labels that a text's quality counts, with white space between their letters; keywords of page routing.
QUALITY_LABELS = ("表題部", "所在", "地番", "地積", "権利部", "甲[区區]", "乙[区區]", "所有者", "権利者")
ROUTE_KEYWORDS = ("表題部", "権利部", "甲区", "乙区", "所在", "地番", "地積", "床面積", "建物面積", "所有者", "権利者", "順位番号", "原因")
GARBLE = r"\x{FFFD}|\?|□|◯|・{2,}"

# Reading sources in order of arrival, with their labels.
SOURCES = (
    ("text-layer", "PDF内の文字情報"),
    ("server", "サーバー側の読み取り"),
    ("ocr-original", "OCR 標準"),
    ("ocr-grayscale", "OCR グレースケール"),
    ("ocr-light", "OCR 明るさ補正"),
    ("ocr-contrast", "OCR コントラスト補正"),
    ("ocr-binary", "OCR 白黒補正"),
    ("ocr-normalized", "OCR 正規化後"),
)
VARIANTS = tuple(s for s, _ in SOURCES[2:7])

# Label variants and what they become, in order; _ stands for any white space.
LABEL_RULES = (
    (r"表 題 部|表題都|表題郡|表題部_\(.*?\)", "表題部"),
    ("土地の表示|填地の表示|地の表示", "土地の表示"),
    ("権 利 部", "権利部"),
    ("甲 區|甲區", "甲区"),
    ("乙 區|乙區", "乙区"),
    ("所 邊|所辺|所 在|所　在|所在地|所奉|所夫", "所在"),
    ("地 番|地盤|地香", "地番"),
    ("地 積|地績|地責", "地積"),
    ("床 面 積|床面 積", "床面積"),
    ("建 物 面 積", "建物面積"),
    ("権 利 者|権利者その他の事項", "権利者その他事項"),
    ("所 有 者|所有 者", "所有者"),
    ("抹 消", "抹消"),
    ("変 更", "変更"),
    ("仮 登 記|仮登記", "仮登記"),
    ("更 正", "更正"),
    ("持_分", "持分"),
    ("原_因", "原因"),
)

# Vocabulary of misread terms (variants, canonical term, report label), in order; _ stands for
# any white space.
VOCABULARY = (
    ("所_有_權", "所有権", "所有權→所有権"),
    ("所有権一部移云", "所有権一部移転", "所有権一部移転補正"),
    ("所_有_権_秘_転|所有権秘転|所有権移云", "所有権移転", "所有権移転補正"),
    ("所_有_権_移_転", "所有権移転", "所有権移転空白補正"),
    ("所_有_権", "所有権", "所有権空白補正"),
    ("所_有_省|所有省", "所有者", "所有者補正"),
    ("能_利_者|能利者|権刑者", "権利者", "権利者補正"),
    ("権_利_者_そ_の_他_の_事_項", "権利者その他事項", "権利者その他事項補正"),
    ("権_利_者", "権利者", "権利者空白補正"),
    ("共_有_者", "共有者", "共有者空白補正"),
    ("原_因|原囚|原回", "原因", "原因補正"),
    ("順_位_番_号|遷委番号", "順位番号", "順位番号補正"),
    ("受_付_年_月_日|受人年月日?", "受付年月日", "受付年月日補正"),
    ("受_付_番_号", "受付番号", "受付番号補正"),
    ("受信", "受付", "受付補正"),
    ("登_記_の_目_的|登記の日的", "登記の目的", "登記の目的補正"),
    ("登記の目的受付", "登記の目的 受付", "登記の目的/受付分割"),
    ("事[頂通]", "事項", "事項補正"),
    ("抵_当_挫", "抵当権", "抵当権補正"),
    ("抵当拍者", "抵当権者", "抵当権者補正"),
    ("共同[#＃]保", "共同担保", "共同担保補正"),
    ("担人の目的", "担保の目的", "担保の目的補正"),
    ("地_図_帯_[呈号]", "地図番号", "地図番号補正"),
    ("令_大|信和|令衝", "令和", "令和補正"),
    ("売_[質買暫]|沈_質", "売買", "売買補正"),
    ("大[機衝開欄限横]町", "大槻町", "大槻町候補補正"),
    ("茶山下", "葉山下", "葉山下候補補正"),
    ("都山市|都市山市|都市市|都市山|都市|部山市|前山市|拓貼市", "郡山市", "郡山市候補補正"),
    ("林式会社|床攻会社", "株式会社", "株式会社補正"),
    ("アー_ネ_ス_ト_ワン|アーネス_トワン|アー_ネスト_ワン", "アーネストワン", "アーネストワン補正"),
    ("波違|濾邊|[sg]辺", "渡辺 OCR候補", "渡辺候補補正"),
    ("所_在", "所在", "所在空白補正"),
    ("所[奉夫]", "所在", "所在候補補正"),
    ("填地の表示|地の表示", "土地の表示", "土地の表示補正"),
    ("地_番", "地番", "地番空白補正"),
    ("地_積", "地積", "地積空白補正"),
    ("床_面_積", "床面積", "床面積空白補正"),
    ("建_物_面_積", "建物面積", "建物面積空白補正"),
    ("表_題_部", "表題部", "表題部空白補正"),
    ("権_利_部", "権利部", "権利部空白補正"),
    ("甲_[区區]", "甲区", "甲区補正"),
    ("乙_[区區]", "乙区", "乙区補正"),
)
NUMBER_LABEL = "数値文脈補正"
PLACE_LABEL = "郡山市候補補正"


def spaced(pattern: str) -> str:
    """The pattern with each _ as any white space."""
    return pattern.replace("_", WS + "*")


def python_pattern(pattern: str) -> str:
    """A pattern of this module in the notation of Python's re."""
    import re

    return re.sub(r"\\x\{([0-9A-Fa-f]{4})\}", lambda m: "\\u" + m[1], pattern).replace(r"\z", r"\Z")
