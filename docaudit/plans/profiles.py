"""Rule profiles and constants as data."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Rule:
    id: str
    section: str
    title: str
    rule_type: str
    field: str
    expected_value: Any
    check_type: str
    severity: str
    content: str = ""
    description: str | None = None
    unit: str | None = None


# The standard's five rules.
STANDARD = [
    Rule(
        "5.1_required_elements", "5.1", "Обязательные структурные элементы", "structure", "required_elements",
        ["титульный лист", "содержание", "определения", "обозначения и сокращения", "введение", "основная часть", "заключение", "список использованных источников", "приложения"],
        "list_presence", "critical",
        "Структурными элементами курсовой работы (проекта) и выпускной квалификационной работы являются: титульный лист; содержание; определения; обозначения и сокращения; введение; основная часть; заключение; список использованных источников; приложения.",
        "Проверка наличия всех обязательных структурных элементов работы",
    ),
    Rule(
        "5.6_introduction", "5.6", "Содержание введения", "structure", "introduction_text",
        ["состояние разработок по теме", "обоснование актуальности", "обоснование новизны", "связь с другими работами", "цель работы", "задачи работы"],
        "list_presence", "warning",
        "Введение должно включать: общую информацию о состоянии разработок по выбранной теме; обоснование актуальности и новизны темы, связь данной работы с другими научно-исследовательскими работами; цель работы и решаемые задачи.",
        "Проверка содержания введения",
    ),
    Rule(
        "6.1.1_font", "6.1.1", "Основные требования к оформлению", "formatting", "font_settings",
        {"font_family": "Times New Roman", "font_size": 14, "line_spacing": 1.5}, "object_equals", "critical",
        "Текст работы печатают шрифтом Times New Roman, 14 пт, через 1,5 интервала.", "Проверка основных параметров форматирования текста",
    ),
    Rule(
        "6.1.1_margins", "6.1.1", "Поля страницы", "formatting", "page_margins", {"left": 25, "right": 15, "top": 20, "bottom": 20}, "object_equals", "critical",
        "Поля: левое - 25 мм, правое - 15 мм, верхнее и нижнее - 20 мм.", "Проверка полей страницы",
    ),
    Rule(
        "6.1.2_paragraph", "6.1.2", "Абзацный отступ", "formatting", "paragraph_indent", 1.25, "equals", "warning",
        "Абзацный отступ должен быть одинаковым по всему тексту и равен 1,25 см.", "Проверка абзацного отступа", "см",
    ),
]

# Other wordings of what an introduction must hold.
SYNONYMS = {
    "состояние разработок по теме": ["состояние исследований", "обзор литературы", "анализ существующих"],
    "обоснование актуальности": ["актуальность темы", "актуальность работы"],
    "обоснование новизны": ["новизна исследования", "новизна работы"],
    "связь с другими работами": ["связь с исследованиями", "взаимосвязь с работами"],
    "цель работы": ["цель исследования", "цель данной работы"],
    "задачи работы": ["задачи исследования", "задачи данной работы"],
}

# What a missing facet says, and advises.
MISSING = {
    "font_settings": ("В документе отсутствуют настройки шрифта", "Добавьте настройки шрифта в документ"),
    "page_margins": ("В документе отсутствуют настройки полей", "Добавьте настройки полей страницы в документ"),
    "paragraph_indent": ("В документе отсутствует настройка абзацного отступа", "Установите абзацный отступ равным 1.25 см"),
}

# Words of title pages, markers, statuses and other names.
TITLE_WORDS_PARAGRAPHS = ["курсовая работа", "дипломная работа", "студент", "преподаватель", "университет", "факультет", "москва", "год"]
TITLE_WORDS_PAGES = ["курсовая работа", "дипломная работа", "студент", "преподаватель", "университет", "факультет"]
TITLE_PAGE, MAIN_PART, INTRODUCTION = "титульный лист", "основная часть", "введение"
HEADING_LINE = r"^(содержание|оглавление|определения|обозначения и сокращения|введение|заключение|список (использованных|литературы|источников)|приложения|\d+\.?\s?[\p{L}\p{N}_]+|глава \d+)"
INTRODUCTION_TEXT = r"(?s)(введение|introduction)(.*?)(\d+\.?\s|глава|основная часть|заключение|conclusion|references|приложения|appendix|список|section)"
STATUSES = ["Загружен", "Анализируется", "Проверен", "Отправлен на доработку", "Идеален"]
PROGRESS = {"Загружен": 0, "Анализируется": 50, "Проверен": 80, "Идеален": 100, "Отправлен на доработку": 100}
COMPLIANT, RETURNED, FAILED, UNKNOWN = "Идеален", "Отправлен на доработку", "Ошибка", "Неизвестно"
LOADED, UNDER_WAY, CHECKED = "Загружен", "Анализируется", "Проверен"
#: What a status may become; "" is a document that has none yet.
TRANSITIONS = {
    "": (LOADED,), LOADED: (UNDER_WAY,), UNDER_WAY: (CHECKED, COMPLIANT, RETURNED, FAILED), CHECKED: (UNDER_WAY, COMPLIANT, RETURNED),
    COMPLIANT: (UNDER_WAY,), RETURNED: (UNDER_WAY,), FAILED: (UNDER_WAY,),
}
MISTAKES = {"critical": ("Ошибка ГОСТ", "high"), "warning": ("Предупреждение ГОСТ", "low")}
DOC_TYPES = {
    "курсовая": "COURSE_WORK", "course": "COURSE_WORK", "бакалаврская": "BACHELOR_THESIS", "bachelor": "BACHELOR_THESIS",
    "магистерская": "MASTER_THESIS", "master": "MASTER_THESIS", "дипломная": "SPECIALIST_THESIS", "specialist": "SPECIALIST_THESIS",
}
ADVICE = [
    "Проверьте шрифт документа - он должен быть Times New Roman",
    "Убедитесь, что размер шрифта составляет 14 пт",
    "Проверьте межстрочный интервал - он должен быть 1.5",
    "Убедитесь, что поля документа соответствуют требованиям ГОСТ",
]
TIERS = [(8, "Документ оформлен хорошо. Можно сдавать."), (5, "Есть важные замечания. Лучше исправить перед сдачей.")]
LOWEST_TIER = "Документ сильно не соответствует ГОСТ. Требуется доработка."

#: Rules for a corpus of plain texts in Latin script.
CORPUS = [
    Rule("c1_elements", "1", "Elements - first words of lines", "structure", "elements", ["the", "licensed", "and", "la"], "list_presence", "critical"),
    Rule("c2_lines", "2", "Number of lines", "formatting", "line_count", {"min": 2, "max": 12}, "range", "warning"),
    Rule("c3_short", "2", "Least words", "formatting", "word_count", 60, "min_value", "warning"),
    Rule("c4_long", "2", "Most words", "formatting", "word_count", 2000, "max_value", "info"),
    Rule("c5_phrase", "3", "Phrase", "content", "full_text", "The ", "contains", "warning"),
    Rule("c6_language", "4", "Language", "content", "lang", "en", "equals", "critical"),
    Rule("c7_source", "4", "Origin", "content", "origin", {"lang": "en", "source": "src0"}, "object_equals", "warning"),
]
