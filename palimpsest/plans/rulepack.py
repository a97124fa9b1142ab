"""Rule packs: what is known about semantic types, and the material that replacements are made of.

A pack is data (JSON in the form of ``RulePack.from_json``, or ``default_pack``); a new semantic type
needs no code, and one that templates can't express brings a function (``with_renderer``). The default
pack's rules are fixed values; its names, streets and texts are our own.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import TypeRegistry, type_id


@dataclass
class Rule:
    semantic_type: str
    rank: int
    canonical_kind: str = "Text"
    mode: str = "Typed"
    names: list[str] = field(default_factory=list)
    comments: list[str] = field(default_factory=list)
    value: str = ""
    checksum: str = ""
    data_types: list[str] = field(default_factory=list)


class Template:
    """A pattern with ``{component}`` places; at least one of them."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.parts: list[tuple[bool, str]] = []  # (is a component, text)
        rest = pattern
        while rest:
            before, brace, rest = rest.partition("{")
            if "}" in before:
                raise ValueError(f"brace without partner: {pattern}")
            if before:
                self.parts.append((False, before))
            if brace:
                name, closed, rest = rest.partition("}")
                if not closed or "{" in name or not name:
                    raise ValueError(f"brace without partner: {pattern}")
                self.parts.append((True, name))
        if not self.components:
            raise ValueError(f"no component in template: {pattern}")

    @property
    def components(self) -> list[str]:
        return [text for is_component, text in self.parts if is_component]


class RulePack:
    """Rules sorted by rank, component lists and templates, checked for consistency."""

    def __init__(self, version: str, rules: list[Rule], components: dict[str, list[str]], templates: dict[str, list[str]], fingerprint: str = "", reserve: dict[str, list[str]] | None = None):
        if not rules or not components:
            raise ValueError("a rule pack has rules and components")
        self.version = version
        #: Functions from an index stream to an array of texts, by type; they go to the workers with the pack.
        self.renderers: dict[str, Callable] = {}
        self.rules = sorted(rules, key=lambda r: r.rank)
        self.registry = TypeRegistry({r.semantic_type: r.rank for r in rules})
        self.components = components
        for name, values in components.items():
            if not values:
                raise ValueError(f"empty component list {name}")
            if len(set(values)) < len(values):
                raise ValueError(f"component list {name} repeats a value")
        self.templates = {type_id(t): [Template(p) for p in patterns] for t, patterns in templates.items()}
        #: Templates with many more values, for domains that the type's own templates are too few for.
        self.reserve = {type_id(t): [Template(p) for p in patterns] for t, patterns in (reserve or {}).items()}
        for t, patterns in [*self.templates.items(), *self.reserve.items()]:
            if not patterns:
                raise ValueError(f"type {t} has no template")
            if missing := {c for p in patterns for c in p.components} - set(components):
                raise ValueError(f"templates of {t} lack components: {', '.join(sorted(missing))}")
        self.fingerprint = fingerprint or hashlib.sha256(json.dumps([version, [vars(r) for r in self.rules], components, templates, *([reserve] if reserve else [])], ensure_ascii=False, sort_keys=True).encode()).hexdigest()

    @classmethod
    def from_json(cls, text: str) -> RulePack:
        """A pack from JSON: version, rules[] (semanticType, rank, canonicalKind, mode, namePatterns,
        commentPatterns, valuePattern, checksum, dataTypes), components{}, templates{}, reserve{}."""
        raw = json.loads(text)
        rules = [
            Rule(type_id(r["semanticType"]), r["rank"], r.get("canonicalKind", "Text"), r.get("mode", "Typed"), r.get("namePatterns", []), r.get("commentPatterns", []), r.get("valuePattern") or "", r.get("checksum") or "", r.get("dataTypes", []))
            for r in raw.get("rules", [])
        ]
        return cls(raw.get("version", ""), rules, raw.get("components", {}), raw.get("templates", {}), hashlib.sha256(text.encode()).hexdigest(), raw.get("reserve"))

    def with_renderer(self, semantic_type: str, render: Callable) -> RulePack:
        """A copy of the pack in which a function renders a type, before anything else the pack has for it."""
        out = copy.copy(self)
        out.renderers = self.renderers | {type_id(semantic_type): render}
        return out

    def cardinality(self, semantic_type: str) -> int:
        """How many different values the templates of a type can give at most, up to 2^64 - 1."""
        total = 0
        for template in self.templates[semantic_type]:
            product = 1
            for name in template.components:
                product *= len(self.components[name])
            total += product
        return min(total, (1 << 64) - 1)

    def wider(self, semantic_type: str) -> RulePack | None:
        """A copy of the pack in which a type is rendered from its reserve; None where it has none."""
        if semantic_type not in self.reserve or semantic_type in self.renderers:
            return None
        out = copy.copy(self)
        out.templates = self.templates | {semantic_type: self.reserve[semantic_type]}
        out.reserve = {t: patterns for t, patterns in self.reserve.items() if t != semantic_type}
        return out

    def name_patterns(self, rule: Rule) -> list[re.Pattern[str]]:
        return [re.compile(p, re.IGNORECASE) for p in rule.names]

    def name_matches(self, rule: Rule, name: Column) -> Column:
        """Whether a column's name looks like the rule's, whatever its case; an expression."""
        found = F.lit(False)
        for pattern in rule.names:
            found = found | name.rlike(f"(?iu){pattern}")
        return found

    def value_matches(self, rule: Rule, value: Column) -> Column:
        """Whether a value looks like the rule's; no value does where the rule has no pattern."""
        return value.rlike(rule.value) if rule.value else F.lit(False)

    def comment_patterns(self, rule: Rule) -> list[re.Pattern[str]]:
        return [re.compile(p, re.IGNORECASE) for p in rule.comments]


TEXT_TYPES = ["char", "varchar", "text", "string"]

# Patterns and ranks by which columns are recognised.
RULES = [
    Rule("inn_person", 5, names=["^inn$", "inn", "инн"], comments=[r"\bИНН\b"], value="^[0-9]{12}$", checksum="inn", data_types=TEXT_TYPES),
    Rule("inn_legal", 6, names=["^inn$", "inn", "инн"], comments=[r"\bИНН\b"], value="^[0-9]{10}$", checksum="inn", data_types=TEXT_TYPES),
    Rule("snils", 7, names=["snils", "снилс"], comments=["СНИЛС"], value="^[0-9]{3}-[0-9]{3}-[0-9]{3} [0-9]{2}$", checksum="snils", data_types=TEXT_TYPES),
    Rule("passport", 8, names=["passport", "паспорт"], comments=["паспорт"], value="^[0-9]{4} [0-9]{6}$", data_types=TEXT_TYPES),
    Rule("phone", 10, names=["phone", "tel(ephone)?$", "телефон"], comments=["телефон"], value=r"^\+7[0-9]{10}$", data_types=TEXT_TYPES),
    Rule("email", 12, "EmailAddress", names=["e-?mail", "почта"], comments=["почт", "email"], value=r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$", data_types=TEXT_TYPES),
    Rule("full_name", 15, names=["full_?name", "^fio$", "^name$", "фио", "имя"], comments=["ФИО", "фамили"], value=r"^\p{L}+ \p{L}+( \p{L}+)?$", data_types=TEXT_TYPES),
    Rule("birth_date", 20, names=["birth", "^dob$", "рожден", "рожде"], comments=["дата рожд"], value="^[0-9]{4}-[0-9]{2}-[0-9]{2}$", data_types=["date"]),
    Rule("postal_address", 25, names=["address", "adres", "адрес"], comments=["адрес"], data_types=TEXT_TYPES),
    Rule("city", 28, names=["^city$", "^town$", "город"], comments=["город"], data_types=TEXT_TYPES),
    Rule("marital_status", 30, names=["marital", "семейн"], comments=["семейное положение"], data_types=TEXT_TYPES),
    Rule("free_text", 90, mode="TextWipe"),
]

STEMS = "Абросим Богдан Ветров Гончар Дорофе Ефрем Журавл Зимин Игнат Калин Лаврент Мельник Некрас Огар Панфил Рогоз Савель Трофим Уваров Филат Харитон Цветк Чернов Шестак Щукин Яхонт Белозёр Вязов Горшк Дубров".split()
MALE = "Андрей Борис Вадим Георгий Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Родион Степан Тарас Фёдор Юрий Ярослав Антон Виктор Григорий Илья Пётр".split()
FEMALE = "Анна Белла Валерия Галина Дарья Евгения Злата Ирина Ксения Любовь Мария Нина Ольга Полина Раиса Светлана Тамара Ульяна Фаина Юлия Яна Алла Варвара Лариса Елена".split()
FATHERS = "Андре Борис Вадим Герман Денис Захар Иван Кирилл Леонид Максим Олег Павл Родион Степан Тарас Фёдор Ярослав Антон Виктор Платон".split()
#: Pairs of letters that last names of the reserve have between stem and ending.
SYLLABLES = "ен ич ук ор ан ик ут ош ел ач яг ун он ыш ар ек ул ол юк ёх ит ом ад ец".split()
CITIES = "Алексин Боровичи Вологда Выборг Галич Елец Жуков Зарайск Ижевск Калуга Кострома Ливны Мышкин Мценск Нерехта Орёл Павловск Псков Ржев Рыбинск Суздаль Тверь Торжок Тула Углич Урюпинск Чухлома Шуя Юрьевец Ярославль".split()
STREETS = "Академическая Базарная Весенняя Гаражная Дальняя Ежевичная Железнодорожная Загородная Ивовая Каштановая Лесная Малиновая Набережная Озёрная Парковая Речная Садовая Тенистая Уютная Фабричная Хвойная Цветочная Черёмуховая Широкая Южная Ясная Верхняя Нижняя Полевая Школьная Липовая Песчаная Родниковая Солнечная Тихая Утренняя Холмистая Энергетиков Новая Заречная".split()
OPENINGS = ["Запись обезличена.", "Сообщение заменено.", "Текст удалён.", "Здесь был текст обращения.", "Примечание скрыто.", "Содержимое стёрто.", "Описание заменено.", "Поле очищено.", "Исходные слова не сохранены.", "Комментарий вымышлен.", "Это замещающий текст.", "Данные изъяты."]
BODIES = ["Смысл записи не передаётся.", "Остальные поля прежние.", "Ключи таблицы согласованы.", "Строка сохранена.", "Порядок строк прежний.", "Размер таблицы прежний.", "Ссылки не нарушены.", "Дата записи прежняя.", "Состояние записи прежнее.", "Номер записи прежний.", "Вид записи прежний.", "Число записей прежнее."]
ENDINGS = ["Подробнее в отчёте.", "Причина указана в отчёте.", "Замена постоянна.", "Замена повторяема.", "Вопросы к владельцу данных.", "Правило записано в политике.", "Исходник остался у владельца.", "Проверка пройдена.", "Отчёт приложен.", "Замена согласована.", "Обратного пути нет.", "Конец замены."]


def default_pack() -> RulePack:
    """The pack that comes with the engine."""
    latin = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya".split(" "), strict=True))
    written = ["".join(latin.get(c, c) for c in s.lower()) for s in STEMS]
    letters = "abcdefghijklmnopqrstuvwxyz"
    components = {
        "last_name_male": [f"{s}ов" for s in STEMS],
        "first_name_male": MALE,
        "patronymic_male": [f"{s}ович" for s in FATHERS],
        "last_name_female": [f"{s}ова" for s in STEMS],
        "first_name_female": FEMALE,
        "patronymic_female": [f"{s}овна" for s in FATHERS],
        "city": CITIES,
        "street": STREETS,
        "house": [str(n) for n in range(1, 100)],
        "flat": [str(n) for n in range(1, 201)],
        "email_local": [f"{s}{end}" for s in written for end in ("ov", "in")],
        "email_second": [*letters, *(f"{a}{b}" for a in "km" for b in letters[:17])],
        "email_domain": [f"{name}.example" for name in ("post", "mail", "box", "letters", "inbox", "office", "home", "work")],
        "inn_region": [f"{n:02d}" for n in range(1, 31)],
        "phone_operator": [str(n) for n in range(900, 920)],
        "passport_series": [f"{40 + n:02d}{n % 24:02d}" for n in range(25)],
        "birth_year": [str(n) for n in range(1946, 2006)],
        "text_opening": OPENINGS,
        "text_body": BODIES,
        "text_closing": ENDINGS,
        "last_name_stem": STEMS,
        "last_name_syllable": SYLLABLES,
        "last_name_end_male": ["ов", "ин"],
        "last_name_end_female": ["ова", "ина"],
        "email_number": [str(n) for n in range(100, 1000)],
    }
    templates = {
        "full_name": ["{last_name_male} {first_name_male} {patronymic_male}", "{last_name_female} {first_name_female} {patronymic_female}"],
        "email": ["{email_local}.{email_second}@{email_domain}"],
        "city": ["{city}"],
        "postal_address": ["ул. {street}, д. {house}, кв. {flat}"],
        "free_text": ["{text_opening} {text_body} {text_closing}"],
    }
    long = "{last_name_stem}{last_name_syllable}{last_name_syllable}{last_name_syllable}"
    reserve = {
        "full_name": [long + "{last_name_end_male} {first_name_male} {patronymic_male}", long + "{last_name_end_female} {first_name_female} {patronymic_female}"],
        "email": ["{email_local}.{email_second}{email_number}{email_number}@{email_domain}"],
        "postal_address": ["г. {city}, ул. {street}, д. {house}, кв. {flat}"],
    }
    return RulePack("default-1", RULES, components, templates, reserve=reserve)
