"""Small tables with cases that the test data lacks, as rows for Spark and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PASSAGES = [
    (1, "I love this bright home. You are not happy here! Was it very good? It was barely good."),
    (2, "She did not enjoy the extremely sweet gift. Never trust a wicked demon. They were hopelessly sad."),
    (3, ""),
    (4, "The table stood by the wall. A cart went past. Nobody spoke of it."),
    (5, 'He said "run now" and she said "wait". *I must go* he thought. _Not again_ she mused.'),
    (6, "Dr. Reed paid 3.50 for it... Then he left. Mr. Fox came at 5 p.m. today."),
    (7, "“Stay,” she whispered. ‘Why?’ he asked. It was a calm, peaceful and lovely evening."),
    (8, "énow at dawn. Çela était bon. Nothing really terrible happened, no panic, no terror."),
    (9, "Utterly brutal murder. Absolutely hopeless chaos! What a tragic, horrible, furious war?"),
    (10, "truly kind\n\nand quite gentle\n \nslightly odd friends. They don't fear. They can't lose."),
    (11, "The computer gave beautiful information. We baked, wanted, rested and jumped. A little apple."),
    (12, "   \n\t  "),
    (13, "joyful joyfulness hopefully mournful fearless paining winning betrayed abusive."),
    (14, "Wait... what is that noise? Run! A gunshot, then silence; the storm and the rain."),
]

PARAGRAPHS = [
    (1, 0, "The bright morning pleased everyone in the house."),
    (1, 1, "Mara walked along the river and counted boats."),
    (1, 2, "Hours later, the harbour was silent."),
    (1, 3, "A fire burned low behind the mill."),
    (2, 0, "At Rivergate, the bells rang twice."),
    (2, 1, "In Stonekeep, nobody heard them."),
    (2, 2, "***"),
    (2, 3, "She remembered when the walls were new."),
    (2, 4, "The guards changed at noon."),
    (3, 0, "I love this happy, joyful and wonderful home."),
    (3, 1, "Murder, horror and brutal death followed us."),
    (3, 2, "Suddenly a horn sounded."),
    (3, 3, "..."),
    (3, 4, "Dreaming of ships, he slept."),
    (3, 5, "Tom walked into Oldtown and sat down."),
    (4, 0, "One."), (4, 1, "Two."), (4, 2, "Three."), (4, 3, "Four."), (4, 4, "Five."), (4, 5, "Six."), (4, 6, "Seven."), (4, 7, "Eight."), (4, 8, "Nine."), (4, 9, "Ten."),
    (5, 0, "---"),
    (5, 1, "   "),
    (5, 2, "Beside the Old Mill they rested."),
    (5, 3, "Beside the Old Mill they ate, and meanwhile it rained."),
]

RAW = [
    (1, "con-\nnection\n12\nPage 3 of 9\n- 4 -\n=====\nThe “end”.......next\n|\n"),
    (2, "A\tB\fC l am here   and\x07there\nﬁne ﬂow​er\n\n\n\n\nLast – line…"),
    (3, " spaced   out \r\n text\r\n\r\n\r\n\r\nmore \n x"),
    (4, "7\n\nbody text of the page\n   22  \nPAGE 9\n######\nfi-\n nal"),
    (5, ""),
    (6, "The well-\nknown path\nled on.\n\nIt ended"),
]

_BODY = "The road went on past the mill and the river, and nobody knew where it would end that day. " * 2
BOOKS = [
    (1, f"Chapter 1\n{_BODY}\nChapter 2: The Return\n{_BODY}\nEPILOGUE\nshort end"),
    (2, f"1. Dawn at the Harbor\n{_BODY}\n2. The Return\n{_BODY}"),
    (3, f"\nAn opening line before all.\n{_BODY}\nPart I\n\nThe Long Way\n{_BODY}\n***\n{_BODY}\n---\nlittle\n###\n{_BODY}"),
    (4, f"THE AWAKENING\n{_BODY}\nBook Two\n====\n{_BODY}\nIV: The Fall\n{_BODY}\nScene 3 - Night\n{_BODY}"),
    (5, "no heading at all\nonly two lines"),
    (6, "Chapter 1\nChapter 2\nChapter 3"),
    (7, f"Prologue - Before\n{_BODY}\nSection IV\n{_BODY}\nAct II.\n{_BODY}\nAppendix\n{_BODY}\n........\n{_BODY}"),
    (8, "   \n "),
]

MARKUP = [
    (1, '[SCENE: The Gate]\n\n[CAMERA: wide shot] the wall at night\n[AMBIENCE: rain] it pours\n"Run!" said Mara and turned away.\n*I must not look*\nBEAT.\nCUT TO: the yard'),
    (2, "[TENSION]\nHe ran fast. [EMOTION: fear]\nGo\n[/TENSION]\n[REFLECTION]\nWas it right? [TENSION: 130]\n[/REFLECTION]\nThe end came slowly... [TENSION: 20]"),
    (3, "A door closed [SFX: SLAM] far away\nThe wind rose SFX: HOWL\nSFX: THUNDER\n[SFX] drip\n(CLOSE ON: the key)\n(WIDE)\n— ✦ —\n***"),
    (4, "[TRANSITION: smash cut: a flash] of light\n[TRANSITION: unknown]\nFADE TO BLACK\nDISSOLVE TO: dawn\n_quiet words_\nWhat a scream it was that nobody in the whole of the old town would ever forget for as long as they lived there by the sea and the hills beyond it"),
    (5, "[GENRE: mystery]\n[TONE: dark, slow]\n[SUMMARY: a short one]\n“Curly” whispered Tom Reed softly.\n[SCENE] Bare title\n[scene]\nPAUSE"),
    (6, ""),
]

BLOCKS = [
    *[(1, i, t, c, s, tm, e, n) for i, (t, c, s, tm, e, n) in enumerate([
        ("title_card", "The Gate", None, None, None, None), ("action", "He ran to the wall and stopped.", None, "quick", "fear", 70), ("dialogue", "Who is there?", "MARA", "normal", "fear", 65),
        ("dialogue", "Who is there?", "MARA", "normal", "fear", 65), ("sfx", "SFX: SLAM", None, None, None, 90), ("transition", "", None, None, None, None), ("inner_thought", "Not again.", None, "slow", "sadness", 40),
        ("beat", "", None, None, None, 20), ("action", "The rain fell on.", None, "slow", "neutral", 25), ("transition", "dawn", None, None, None, 30), ("dialogue", "We made it.", "TOM", "rapid", "joy", 15),
    ])],
    *[(2, i, "action", f"Step {i} was like the one before it.", None, "normal", "neutral" if i % 2 else "joy", 50) for i in range(20)],
    *[(3, i, "sfx", f"SFX: BANG {i}", None, "rapid", None, 95) for i in range(10)],
    *[(4, i, "sfx" if i % 6 in (0, 1, 2, 3) else "action", "Loud.", None, None, "anger" if i % 3 else "surprise", (i * 7) % 101) for i in range(35)],
    (5, 0, "beat", "", None, None, None, None),
]

SNAPSHOTS = [
    *[("a", 1 + i // 4, "original", round(0.05 * i, 3), 40 * i, 1_700_000_000_000 + 1000 * t) for i, t in enumerate([0, 19, 20, 41, 61, 82, 1282, 2483, 2502, 4000, 90_000, 90_050])],
    *[("b", 2, "original" if i % 5 else "staged", 0.5 if i % 2 else 0.505, 10 * i, 1_700_000_100_000 + 5_000 * i) for i in range(40)],
    ("c", 1, "original", 1.4, -5, 1_700_000_000_500),
]

CHAPTERS = [("a", n, f"Chapter {n}", 1000 + 250 * n, n < 3) for n in range(1, 6)] + [("b", n, f"Part {n}", 800, n == 1) for n in range(1, 4)] + [("c", 1, "Only", 0, True)]
PROGRESS = [("a", 3, 600, [1, 2], [1, 4]), ("b", 2, 45, [1], []), ("c", 1, 0, [], [2])]

PROVIDERS = [
    ("local", 0.0, 50, True, 8_000, 1_000, False, True, False), ("small", 0.00025, 400, True, 32_000, 2_000, True, True, True), ("fast", 0.00027, 300, True, 32_768, 4_000, True, True, False),
    ("large", 0.00075, 500, True, 128_000, 4_096, True, True, True), ("ill", 0.001, 600, False, 131_072, 4_096, True, False, False), ("best", 0.009, 700, True, 200_000, 8_192, True, True, True),
]
POLICIES = [(1, "low", False, 0.0, True, False), (2, "medium", True, 0.002, False, True), (3, "high", True, 0.05, False, False), (4, "critical", True, 1.0, False, True), (5, "low", True, 0.0001, False, False)]

JOB_EVENTS = [
    ("j1", 1, "enqueued", 0), ("j1", 2, "started", 10), ("j1", 3, "completed", 50),
    ("j2", 1, "enqueued", 1), ("j2", 2, "started", 11), ("j2", 3, "failed", 20), ("j2", 4, "started", 2100), ("j2", 5, "completed", 2200),
    ("j3", 1, "enqueued", 2), ("j3", 2, "started", 12), ("j3", 3, "failed", 21), ("j3", 4, "started", 1500), ("j3", 5, "failed", 1600), ("j3", 6, "started", 4000), ("j3", 7, "failed", 4100),
    ("j4", 1, "enqueued", 3), ("j4", 2, "cancelled", 5),
    ("j5", 1, "enqueued", 4), ("j5", 2, "started", 13),
]

REQUESTS = [(f"r{i}", ["local", "small", "best"][i % 3], f"u{i % 4}", f"p{i % 7}", 1_000 * i + (i * 37) % 500, 50 + (i * 91) % 800, i % 5 not in (1, 2) if i < 20 else i % 9 < 5) for i in range(60)]

#: name: (schema, rows)
TABLES = {
    "fx_passages": ("doc_id bigint, text string", PASSAGES),
    "fx_paragraphs": ("doc_id bigint, pos int, text string", PARAGRAPHS),
    "fx_raw": ("doc_id bigint, text string", RAW),
    "fx_books": ("doc_id bigint, text string", BOOKS),
    "fx_markup": ("doc_id bigint, text string", MARKUP),
    "fx_blocks": ("doc_id bigint, pos int, type string, content string, speaker string, timing string, emotion string, tension int", BLOCKS),
    "fx_snapshots": ("book string, chapter int, mode string, scroll double, read_sec int, ts bigint", SNAPSHOTS),
    "fx_chapters": ("book string, number int, title string, word_count bigint, is_processed boolean", CHAPTERS),
    "fx_progress": ("book string, current int, read_sec bigint, read_chapters array<int>, bookmarks array<int>", PROGRESS),
    "fx_providers": ("name string, cost_per_1k double, latency_ms int, healthy boolean, context int, max_tokens int, streams boolean, json boolean, top_tier boolean", PROVIDERS),
    "fx_policies": ("policy int, complexity string, needs_stream boolean, max_cost double, prefer_fastest boolean, require_json boolean", POLICIES),
    "fx_job_events": ("job string, seq int, kind string, ts bigint", JOB_EVENTS),
    "fx_requests": ("request string, provider string, user_id string, prompt string, ts bigint, tokens int, ok boolean", REQUESTS),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<int>": "INTEGER[]"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]::INTEGER[]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x)


def cte(name: str) -> str:
    """``name AS (...)`` with the table's rows, for a WITH clause."""
    schema, rows = TABLES[name]
    fields = [f.strip().split(" ") for f in schema.split(",")]
    values = ",\n  ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    casts = ", ".join(f"{n}::{_SQL_TYPES[t]} AS {n}" for n, t in fields)
    return f"{name} AS (SELECT {casts} FROM (VALUES\n  {values}) v({', '.join(n for n, _ in fields)}))"
