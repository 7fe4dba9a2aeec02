"""Classification of messages by ordered rules, as columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_hit, first_hit

# The cues of the routes and options.
MAP = ("概念地図", "概念マップ", "コンセプトマップ", "地図にして", "図にして", "整理して", "可視化", "マッピング", "concept map", "visuali", "map my", "描いて", "作図")
VECTOR = ("とは", "何ですか", "なんですか", "教えて", "いつ", "どこ", "誰が", "何件", "どのくらい", "定義", "意味は", "what is", "who ", "when ", "where ", "how many", "explain")
BASIC = ("こんにちは", "ありがとう", "おはよう", "hello", "hi ", "thanks", "使い方", "help", "ヘルプ", "できること")
LOCAL = ("との関係", "の関係", "との繋がり", "とのつながり", "どう繋が", "どうつなが", "どう関係", "なぜ", "どうして", "経緯", "原因", "影響")
GLOBAL = ("全体像", "俯瞰", "全体をまとめ", "全体を通して", "テーマは", "何がわかって", "何が分かって", "横断して", "横断で")
HYBRID = ("比較して", "比べて", "整理した上で", "踏まえた上で")
MAP_VERBS = ("整理して", "作成", "作って", "描いて", "生成", "地図として", "地図に", "マップ化", "図にして")
QUESTION = ("教えて", "ですか", "ますか", "ましたか", "でしょうか")
LEVELS = {
    "detailed": ("詳細", "細かく", "詳しく", "detailed", "精査", "深く"),
    "overview": ("概観", "俯瞰", "ざっくり", "全体像", "overview", "大まか", "簡単に"),
    "standard": ("標準", "standard", "通常"),
}
LANGUAGES = {"en": ("英語で", "in english", "english"), "ja": ("日本語で", "in japanese", "japanese")}
ALL = {"map": MAP, "vector": VECTOR, "basic": BASIC, "local": LOCAL, "global": GLOBAL, "hybrid": HYBRID, "map_verb": MAP_VERBS, "question": QUESTION}


def is_question(message: Column, cues=QUESTION) -> Column:
    t = F.trim(message)
    return t.endswith("?") | t.endswith("？") | any_hit(t, cues)


def _first_group(message: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for name, cues in groups.items():
        out = F.when(any_hit(message, cues), name) if out is None else out.when(any_hit(message, cues), name)
    return out


def detail_level(message: Column, groups=None) -> Column:
    """detailed before overview before standard; null without a cue."""
    return _first_group(message, groups or LEVELS)


def language(message: Column, groups=None) -> Column:
    return _first_group(message, groups or LANGUAGES)


def tags(message: Column) -> Column:
    """Sorted distinct words after ``#``."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(r"#([^\s#、,]+)"), 1)))


def has_window(message: Column) -> Column:
    return message.rlike(r"(?:直近|過去)\s*\d+\s*日") | any_hit(message, ("先週", "今月", "今週"))


def window_start(message: Column, now: Column) -> Column:
    """Lower bound of the period that a message names; seven days by default."""
    days = F.regexp_extract(message, r"(?:直近|過去)\s*(\d+)\s*日", 1)
    week = F.date_trunc("week", now)
    return (
        F.when(days != "", now - F.make_dt_interval(F.expr("try_cast(0 as int)") + days.cast("int")))
        .when(message.contains("先週"), week - F.expr("interval 7 days"))
        .when(message.contains("今月"), F.date_trunc("month", now))
        .when(message.contains("今週"), week)
        .otherwise(now - F.expr("interval 7 days"))
    )


def parse_window(message: str, now: dt.datetime) -> dt.datetime:
    """:func:`window_start` of one message, on the driver."""
    if m := re.search(r"(?:直近|過去)\s*(\d+)\s*日", message):
        return now - dt.timedelta(days=int(m[1]))
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    monday = day - dt.timedelta(days=now.weekday())
    for cue, start in (("先週", monday - dt.timedelta(days=7)), ("今月", day.replace(day=1)), ("今週", monday)):
        if cue in message:
            return start
    return now - dt.timedelta(days=7)


def route(message: Column, classified: Column | None = None, cues: dict | None = None, default: str = "map", short: int = 40) -> Column:
    """The route of a message: the first rule that applies. ``classified`` is an optional classifier's answer."""
    c = ALL | (cues or {})
    hit = {k: first_hit(message, c[k]).isNotNull() for k in ("map", "vector", "basic", "local", "global", "hybrid", "map_verb")}
    qa = hit["map"] & (hit["local"] | hit["global"]) & is_question(message, c["question"]) & ~hit["map_verb"]
    both = hit["hybrid"] | (hit["local"] & hit["global"])
    out = (
        F.when(hit["map"] & ~qa, "map")
        .when(hit["basic"] & ~hit["vector"] & (F.length(message) <= short), "basic")
        .when(both, "hybrid")
        .when(hit["local"], "local")
        .when(hit["global"], "global")
        .when(hit["vector"], "vector")
        .when(has_window(message), "map")
    )
    if classified is not None:
        out = out.when(classified.isin("basic", "vector", "map", "local", "global", "hybrid"), classified)
    return out.otherwise(default)
