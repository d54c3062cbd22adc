"""Small tables that operators take as parameters, as the queries over the test tables use them: samples, not whole vocabularies."""

from __future__ import annotations

# Ideographs by their strokes, as the reference counts them.
_STROKES = {
    1: "一",
    2: "二七八九十了人力",
    3: "三千万亿也与口山川土大小上下",
    4: "五六元不从比为以月日分今手心木火水风云天长少中内开支止公文",
    5: "四他它们让叫对可目头皮石旧东北左右外市民厅写去用出打发令示布业击乐",
    6: "百在她那有向而如年后早过耳血肉江地多好西军会吃买关回问权导压字网传产争守",
    7: "我你这没把但时足体身花低坏快冷里间县局听走来进找批报声财攻防兵忧",
    8: "的和或到所周明现空金雨林河软国府官法委卖知使放取命制治服表泄话述经易贫武怕苦怀念",
    9: "是将秒昨前草树重轻南省室政律院说看给带度则指统查封信音济贸战炸怒盼",
    10: "被脸骨脑海高弱热旁家党读监配准秘透息钱资核爱恨恐恶",
    11: "都晚眼雪强部做得规控理许隐密盖叙描银望",
    12: "湖短硬喝挥属掩揭堵媒富税款悲喜痛善",
    13: "腿新署想督禁暗愁",
    14: "鼻慢领管语",
    15: "审影播敌",
    16: "器",
    17: "臂藏讲",
    21: "露",
}
STROKES = [(ch, n) for n, chars in _STROKES.items() for ch in chars]

# Seeds of the poles, the first of each list; the whole lists are a table that the caller gives.
SEEDS = {
    ("en", "resources", "scarcity"): "ration deficit starvation strict squeeze tight scarce shortage deplete limit",
    ("en", "resources", "abundance"): "surplus flood lavish endless asset wealth overflow generous ample plentiful",
    ("en", "power", "control"): "enforce dictate authorize grid deploy command dominate govern mandate surveillance",
    ("en", "power", "submission"): "endure assign force sweep yield comply submit obey subordinate defer",
    ("en", "visibility", "concealment"): "obscure intercept veil encrypt shadow layer hide conceal mask cover",
    ("en", "visibility", "exposure"): "broadcast clear obvious surface bright reveal expose transparent open visible",
    ("en", "temporal", "past_nostalgic"): "roots restore memory before legacy return tradition former remember recall",
    ("en", "temporal", "future_projective"): "horizon incoming advance threat trajectory progress innovate emerge vision target",
    ("en", "cognitive", "scientific"): "calculate variable physics metric observe structure analyze empirical parameter measure",
    ("en", "cognitive", "emotional"): "feel hope soul despair intuitive abstract sense believe dream suffer",
    ("en", "kinetic", "aggression"): "strike breach kinetic eliminate target attack assault destroy neutralize rupture",
    ("en", "kinetic", "diplomacy"): "negotiate hold stall treaty balance ceasefire dialogue mediate stabilize pause",
}
#: Seeds of scripts with other word rules, made for the tests.
OTHER_SEEDS = {
    ("ar", "power", "control"): "أمر مجلس", ("ar", "kinetic", "diplomacy"): "معاهدة سلام", ("zh", "power", "control"): "命令 委员会", ("zh", "visibility", "concealment"): "隐瞒 掩盖", ("zh", "kinetic", "diplomacy"): "条约 谈判",
    ("ko", "power", "control"): "위원회는 당국은", ("ko", "kinetic", "diplomacy"): "조약의 협상단은",
}
#: Word fields, made for the tests: field -> words.
FIELDS = {"nature": "river valley storm night dawn rain sea winter", "war": "fort garrison attack defence threat raid", "state": "council committee minister government treaty law", "money": "price coal budget quota stock cost"}


def rows(table: dict[tuple[str, str, str], str]) -> list[tuple[str, str, str, str, int]]:
    """(lang, cluster, pole, word, ord) of a table of seeds."""
    return [(*names, w, k) for k, (names, w) in enumerate((names, w) for names, ws in table.items() for w in ws.split())]


#: Lines of a lexicon of valence, arousal and dominance, made for the tests: (file_name, line_no, raw_line).
VAD_LINES = [
    ("vad_en.tsv", 1, "Word\tValence\tArousal\tDominance"), ("vad_en.tsv", 2, "council\t0.6\t0.4\t0.8"), ("vad_en.tsv", 3, "night\t0.45\t0.3\t0.35"), ("vad_en.tsv", 4, "storm\t0.2\t0.9\t0.7"), ("vad_en.tsv", 5, "treaty\t0.7\t0.3\t0.6"),
    ("vad_en.tsv", 6, "fear\t0.05\t0.85\t0.2"), ("vad_en.tsv", 7, "Council\t1.4\t0.5\t0.9"), ("vad_en.tsv", 8, "short\t0.5\t0.5"), ("vad_en.tsv", 9, "bad\tx\t0.1\t0.2"), ("vad_en.tsv", 10, "two words\t0.5\t0.5\t0.5"), ("vad_en.tsv", 11, "minister\t0.5\t0.45\t0.85"), ("vad_en.tsv", 12, ""),
    ("vad_de.tsv", 1, "Word\tValence\tArousal\tDominance\tTranslated"), ("vad_de.tsv", 2, "council\t0.6\t0.4\t0.8\tRat"), ("vad_de.tsv", 3, "night\t0.45\t0.3\t0.35\tNacht"), ("vad_de.tsv", 4, "harbour\t0.55\t0.35\t0.5\t "), ("vad_de.tsv", 5, "fear\t0.05\t0.85\t0.2\tAngst"),
]

#: Texts that hold devices which the test documents lack, made for the tests.
DEVICES = [
    (1, "He was as brave as a lion. She was as quiet as the snow."), (2, "I told you a million times. It lasted for a thousand years. We waited forever and ever."), (3, "That is not bad. It was not an unkind word."), (4, "He came and saw and spoke and left. Ships or boats or rafts or planks."),
    (8, "It spread like a fog. I like music. It was the greatest storm in history. The forest was the best ever. They came, they saw, they left."),
    (5, "It was an open secret. The living and the dead met."), (6, "The river whispers at night. A storm raged. They whisper."), (7, "I believe the data shows a clear result. According to experts the evidence proves it. Because of this we fear for our children."),
]
