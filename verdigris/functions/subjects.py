"""Subject labels of courses, by code prefix or by words in name, code, module and department."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_course_name, text_of

#: Label, code prefixes, pattern.
SUBJECT_RULES = (
    ("foreign_language", ("ENG",), "英语|外语|雅思|托福|跨文化交际|听说写|商务英语"),
    ("physical_education", ("PED",), "体育|篮球|足球|体能|体育舞蹈|武术"),
    ("mathematics", ("MAT",), "数学|微积分|代数|概率|数理统计|运筹学|离散"),
    ("computing", ("CST", "DSC"), "程序设计|编程|计算机|数据结构|人工智能|机器学习|深度学习|算法"),
    ("programming", (), "(?i)程序设计|编程|Python|Java|C语言"),
    ("ideological_political", ("IPT",), "思想道德|马克思|中国特色社会主义|形势与政策|中国近现代史|习近平新时代"),
    ("military_education", ("MTI",), "军事理论|军事技能|国家安全教育|军训"),
)
#: A course whose name has this is no programming course.
NOT_PROGRAMMING = "数据结构"


def subjects_of(name: Column, code: Column, module: Column, department: Column, rules=SUBJECT_RULES) -> Column:
    """All labels that fit, in rule order."""
    clean, upper = clean_course_name(name), F.upper(text_of(code))
    searched = F.concat_ws(" ", clean, upper, text_of(module), text_of(department))
    labels = []
    for label, prefixes, pattern in rules:
        fits = searched.rlike(pattern)
        if label == "programming":
            fits = fits & ~clean.contains(NOT_PROGRAMMING)
        for prefix in prefixes:
            fits = fits | upper.startswith(prefix)
        labels.append(F.when(fits, F.lit(label)))
    return F.array_compact(F.array(*labels))


def matches_subjects(subjects: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(subjects, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)
