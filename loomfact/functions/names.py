"""Rules over names: clamping, relation types, suffix tiers, safety of aliases.

The rules are tables given as arguments; the small tables here are examples in the form
that a user's own take.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Marks at which a list of names is cut.
SEPARATORS = "[、，,;；/|]"
#: Example tables, in order of precedence.
RELATION_WORDS = (("father", "parent"), ("mother", "parent"), ("brother", "sibling"), ("sister", "sibling"), ("enemy", "enemy"), ("friend", "friend"), ("master", "teacher"))
RELATION_CLASSES = (("family", ("parent", "sibling", "spouse")), ("hostile", ("enemy", "rival")), ("intimate", ("lover",)), ("social", ("friend", "teacher")))
PLACE_SUFFIXES = (("国", "kingdom", 1), ("州", "region", 2), ("城", "city", 3), ("山", "site", 4), ("寺", "building", 5), ("殿", "building", 5), ("房", "building", 5))
ORG_WORDS = ("门", "派", "宗", "帮", "会")
GENERIC_PEOPLE = ("众人", "士兵", "路人", "丫鬟")
HONORIFICS = ("老爷", "夫人", "公子", "小姐", "大人")


def clamped(name: Column, most: int = 20) -> Column:
    """Stripped, cut at the first list mark, at most ``most`` characters."""
    return F.substring(strip(F.split(strip(name), SEPARATORS)[0]), 1, most)


def first_contained(value: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The value of the exact key, else of the first key contained, else the text itself."""
    out = None
    for k, v in table:
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    for k, v in table:
        out = out.when(F.contains(value, F.lit(k)), v)
    return out.otherwise(value)


def relation_type(raw: Column) -> Column:
    return first_contained(F.lower(strip(raw)), RELATION_WORDS)


def relation_class(kind: Column) -> Column:
    out = None
    for name, kinds in RELATION_CLASSES:
        out = F.when(kind.isin(*kinds), name) if out is None else out.when(kind.isin(*kinds), name)
    return out.otherwise("other")


def suffix_of(name: Column, what: int) -> Column:
    """The place type (1) or rank (2) of the first suffix in the table that the name ends in."""
    out = None
    for row in PLACE_SUFFIXES:
        hit = F.endswith(name, F.lit(row[0]))
        out = F.when(hit, row[what]) if out is None else out.when(hit, row[what])
    return out


def is_org_place(kind: Column) -> Column:
    return kind.rlike("|".join(ORG_WORDS))


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def only_cjk(text: Column) -> Column:
    return text.rlike("^[一-鿿]*$")


def is_generic_place(name: Column) -> Column:
    """The first rule by which a place is generic, null for none."""
    return (
        F.when(F.char_length(name) > 7, "too_long")
        .when(F.contains(name, F.lit("的")), "phrase")
        .when(F.endswith(name, F.lit("处")) & (F.char_length(name) <= 2), "somewhere")
        .when(name.rlike("^(一|两|几|某)(个|座|间|条)?"), "quantity")
        .when(name.rlike("^(东|西|南|北|前|后|左|右)(边|面|方|侧)$"), "direction")
    )


def is_generic_person(name: Column) -> Column:
    return (
        F.when(name.isin(*GENERIC_PEOPLE), "listed")
        .when(name.rlike("^(众|群)"), "group")
        .when(F.char_length(name) >= 10, "too_long")
        .when(F.contains(name, F.lit("的")) & (F.char_length(name) >= 4), "phrase")
        .when((F.char_length(name) == 2) & F.endswith(name, F.lit("氏")), "surname_only")
    )


def alias_safety(alias: Column) -> Column:
    """0 never an alias, 1 doubtful, 2 safe."""
    return (
        F.when(alias.isin(*GENERIC_PEOPLE) | (F.char_length(alias) == 0), 0)
        .when((F.char_length(alias) == 1) | alias.isin(*HONORIFICS), 0)
        .when(F.coalesce(*(F.when(F.endswith(alias, F.lit(h)), True) for h in HONORIFICS), F.lit(False)) | (F.char_length(alias) > 6), 1)
        .otherwise(2)
    )


def is_nickname(name: Column) -> Column:
    return F.coalesce(*(F.when(F.endswith(name, F.lit(h)), True) for h in HONORIFICS), F.lit(False)) | name.rlike("^(小|老|阿).$")


# ---- fixed values: architectural characters, realm characters, surnames, titles, verbs of events, directions and their opposites, words of questions
ARCHITECTURE = "门道廊厅堂殿阁楼房室间院墙窗阶梯井亭台榭轩斋"
REALM = "幻梦仙灵冥虚魔"
SURNAMES = (
    "贾", "史", "王", "薛", "林", "李", "张", "刘",
    "陈", "杨", "赵", "孙", "周", "吴", "郑", "冯",
    "褚", "卫", "蒋", "沈", "韩", "朱", "秦", "尤",
    "许", "何", "吕", "曹", "魏", "蔡", "宋", "郭",
    "潘", "范", "彭", "鲁", "马", "苗", "花", "方",
    "任", "袁", "柳", "酆", "鲍", "雷", "贺", "倪",
    "汤", "殷", "苏", "黄",
    "诸葛", "司马", "上官", "欧阳", "公孙", "太史",
)
#: A name is told by its first letter, so only surnames of one letter decide.
SURNAME_LETTERS = "".join(s for s in SURNAMES if len(s) == 1)
RESIDENT_TITLES = ("夫人", "老爷", "太太", "姑娘", "小姐", "奶奶", "嫂子", "姨妈", "姐姐", "妹妹", "哥哥", "弟弟")
#: Ranks, offices and houses before 府 that make it a residence.
RANKS = (
    "太师", "太尉", "太保", "太傅", "丞相", "相国", "宰相", "国丈",
    "将军", "元帅", "都督", "刺史", "知府", "知县", "提辖", "总管",
    "大人", "员外", "长史", "侍郎", "尚书", "学士", "御史",
    "王", "公", "侯", "伯",
    "贾", "史", "薛", "林", "荣国", "宁国", "北静王", "南安王",
    "宿太尉", "高太尉", "蔡太师", "童贯",
)
NO_RESIDENTS = ("出", "住", "去", "归", "深", "高阜", "别", "来", "过", "到")
EVENT_VERBS = "插打杀死烧逃逮擒困埋葬砍斩缢吊投跳溺捆绑尽毙亡殁败"
OPPOSITES = {"north_of": "south_of", "east_of": "west_of", "northeast_of": "southwest_of", "northwest_of": "southeast_of"}
URL_MARKS = r"(?i)https?://|www\.|\.com|\.cn|\.net|\.org|\.txt"
INVALID_KINDS = {"item": "出现", "org": "加入"}
# ----
#: Example of names that many buildings have, and of words in questions with the relation types that they ask for.
HOMONYMS = ("夹道", "角门", "后门", "正房", "书房", "花园", "皇宫", "山洞")
ASKED_RELATIONS = (("恋人", ("恋人", "爱慕", "夫妻")), ("师徒", ("师徒", "传授")), ("敌人", ("敌对", "仇敌")), ("朋友", ("朋友", "知己")))


def is_homonym_prone(name: Column) -> Column:
    """Names that several buildings of a novel have: listed, or at most two characters that all name parts of buildings."""
    return name.isin(*HOMONYMS) | name.rlike(f"^[{ARCHITECTURE}]{{0,2}}$")


def is_surname_shi(name: Column, surnames: str = SURNAME_LETTERS) -> Column:
    return name.rlike(f"^[{surnames}]氏$")


def is_realm(name: Column) -> Column:
    return name.rlike(f"[{REALM}]")


def is_residence(name: Column, parent_tier: Column, ranks: tuple[str, ...] = RANKS, surnames: str = SURNAME_LETTERS) -> Column:
    """Whether a name ending in 府 is a house: of a rank, of a surname, or inside a city, kingdom or continent."""
    owner = name.rlike(f"({'|'.join(ranks)})府$") | name.rlike(f"^[{surnames}].?府$")
    return name.rlike("^.+府$") & (owner | F.coalesce(parent_tier.isin("city", "kingdom", "continent"), F.lit(False)))


def is_place_of_person(name: Column, titles: tuple[str, ...] = RESIDENT_TITLES, surnames: str = SURNAME_LETTERS) -> Column:
    """Whether a name ending in 处 is where a person lives: by surname or title, or short and without the verb of an event."""
    before = F.substring(name, 1, F.char_length(name) - 1)
    person = (F.char_length(before) <= 5) & (before.rlike(f"^[{surnames}]") | before.rlike(f"({'|'.join(titles)})$"))
    short = (F.char_length(before) <= 4) & ~before.rlike(f"[{EVENT_VERBS}]")
    return name.rlike("^.+处$") & ~before.isin(*NO_RESIDENTS) & (person | short)


def is_url_like(text: Column) -> Column:
    """An address, also with spaces in between or in full-width letters."""
    wide = "".join(chr(c + 0xFEE0) for c in [*range(65, 91), *range(97, 123), 46])
    narrow = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), 46])
    return F.translate(F.replace(text, F.lit(" "), F.lit("")), wide, narrow).rlike(URL_MARKS)


def asked_relations(question: Column, table: tuple[tuple[str, tuple[str, ...]], ...] = ASKED_RELATIONS) -> Column:
    """Relation types that the first word of ``table`` in a question asks for, null for none."""
    out = None
    for word, kinds in table:
        hit, value = F.contains(question, F.lit(word)), F.lit(",".join(kinds))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def opposing(kind: Column, other: Column, same: Column, reversed_: Column) -> Column:
    """Whether two directions contradict: opposite ones between the same places, or equal ones between places the other way round."""
    both = OPPOSITES | {v: k for k, v in OPPOSITES.items()}
    against = F.coalesce(*(F.when(kind == k, other == v) for k, v in both.items()), F.lit(False))
    return (against & (same | reversed_)) | ((kind == other) & reversed_)


def normalised_variant(name: Column, exact: dict[str, str], characters: tuple[str, str]) -> Column:
    """The usual form of a name: the table's for all of it, else character by character, and the table's again."""
    def listed(c: Column) -> Column:
        return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in exact.items()), c)

    return listed(F.translate(listed(name), *characters))
