"""Text functions on columns. Null counts as an empty text unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.trends import first_match

#: Letters with diacritics and their plain letters; the letter đ has none and is dropped with other signs.
ACCENTED = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵäëïöüñç"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyaeiounc"
#: Places by what users may type (normalised) and the terms to search for; the first group that fits counts.
PLACES = (
    (("ha noi", "hanoi", "hn"), ("hà nội", "ha noi", "hanoi")),
    (("ho chi minh", "hcm", "tphcm", "tp hcm", "sai gon", "saigon"), ("hồ chí minh", "ho chi minh", "tphcm", "tp hcm", "hcm")),
    (("da nang", "danang", "dn"), ("đà nẵng", "da nang", "danang")),
    (("hai phong", "haiphong", "hp"), ("hải phòng", "hai phong", "haiphong")),
    (("can tho", "cantho"), ("cần thơ", "can tho", "cantho")),
    (("bien hoa", "bienhoa"), ("biên hòa", "bien hoa", "bienhoa")),
    (("vung tau", "vungtau"), ("vũng tàu", "vung tau", "vungtau")),
)
#: Job levels, technology categories, roles, sentiment words and source names.
LEVELS = {"fresher": ("fresher", "thực tập sinh"), "junior": ("junior", "nhân viên mới", "nhân viên"), "mid": ("mid", "trung cấp"), "senior": ("senior", "trưởng nhóm", "làm việc trực tiếp"), "lead": ("lead", "team lead", "kiến trúc sư")}
CATEGORIES = {
    "AI": ("ai", "machine learning", "ml", "deep learning", "neural network", "gpt", "llm", "nlp", "computer vision"),
    "Cloud": ("aws", "azure", "gcp", "cloud computing", "docker", "kubernetes", "serverless", "container"),
    "DevOps": ("devops", "ci/cd", "jenkins", "gitlab", "github actions", "terraform", "ansible", "prometheus"),
    "Frontend": ("react", "vue", "angular", "javascript", "typescript", "css", "html", "next.js"),
    "Backend": ("python", "java", "node.js", "go", "c#", ".net", "ruby", "php", "spring boot"),
    "Database": ("sql", "mongodb", "postgresql", "mysql", "redis", "elasticsearch", "cassandra", "dynamodb"),
    "Mobile": ("ios", "android", "react native", "flutter", "swift", "kotlin"),
    "Data": ("data science", "analytics", "bi", "spark", "hadoop", "tableau", "power bi", "etl"),
}
ROLES = {"CEO": ("ceo", "chủ tịch", "giám đốc điều hành"), "CTO": ("cto", "giám đốc công nghệ", "chief technology"), "Founder": ("sáng lập viên", "founder", "nhà sáng lập"), "Engineer": ("engineer", "kỹ sư", "developer"), "Researcher": ("researcher", "nhà nghiên cứu", "research"), "Manager": ("quản lý", "manager", "giám đốc")}
GOOD = ("tăng", "tốt", "thành công", "đột phá", "nâng cao", "cải thiện", "mạnh mẽ", "hiệu quả", "tiên tiến")
BAD = ("giảm", "xấu", "thất bại", "lỗi", "vấn đề", "rủi ro", "lo ngại", "yếu", "kém", "cảnh báo")
SOURCES = {"GenK": "GenK", "DanTri": "Dân Trí", "Dân Trí": "Dân Trí", "VN-EP": "VNExpress", "VNExpress": "VNExpress", "topCV": "TopCV", "TopCV": "TopCV"}
BAD_ENDS = ("Cuối", "Quy", "Phía", "Store", "YouTube")


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_place(c) -> Column:
    """Lower case, without diacritics and signs, single spaces."""
    plain = F.translate(F.lower(_text(c)), ACCENTED, PLAIN)
    return _squeezed(F.regexp_replace(plain, r"[^a-z0-9\s]", ""))


def place_terms(c, places=PLACES) -> Column:
    """Search terms of a place: those of the first group of which a name holds the text or is held by it, else the text
    itself; a blank place has none."""
    norm = normalize_place(c)
    out = F.array(norm)
    for names, terms in reversed(places):
        fits = F.lit(False)
        for n in names:
            fits = fits | F.contains(norm, F.lit(n)) | F.contains(F.lit(n), norm)
        out = F.when(fits, F.array(*map(F.lit, terms))).otherwise(out)
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(out)


def at_place(location, terms: Column) -> Column:
    """Whether any of the terms occurs in the lower-cased location."""
    low = F.lower(_text(location))
    return F.exists(terms, lambda t: F.contains(low, t))


def salary_min(c) -> Column:
    """The number before `-` or alone, in front of `triệu`; null if there is none."""
    s = F.trim(F.split(_text(c), "triệu")[0])
    s = F.trim(F.regexp_replace(s, "^(Từ )?(từ )?", ""))
    return F.coalesce(F.when(F.locate("-", s) > 1, F.trim(F.substring_index(s, "-", 1)).try_cast("double")), s.try_cast("double"))


def salary_range(c) -> Column:
    """struct(low, high) of the first two whole numbers; nulls where there are fewer."""
    n = F.regexp_extract_all(_text(c), F.lit(r"(\d+)"), F.lit(1))
    two = F.size(n) >= 2
    return F.struct(F.when(two, n[0].try_cast("long")).alias("low"), F.when(two, n[1].try_cast("long")).alias("high"))


def parse_date(c, as_of: str) -> Column:
    """The first of four formats that fits, else as_of."""
    formats = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(_text(c), F.lit(f)) for f in formats], F.lit(as_of).cast("timestamp"))


def job_level(c) -> Column:
    return first_match(_text(c), LEVELS, "mid")


def tech_category(c, groups: Mapping[str, Sequence[str]] = CATEGORIES) -> Column:
    return first_match(_text(c), groups, "Other")


def person_role(context) -> Column:
    return first_match(_text(context), ROLES, "Unknown")


def sentiment(c, good: Sequence[str] = GOOD, bad: Sequence[str] = BAD) -> Column:
    """(p - n) / (p + n) over the words of each list that occur; 0 if none does."""
    low = F.lower(_text(c))
    p, n = (sum(F.contains(low, F.lit(w)).cast("int") for w in words) for words in (good, bad))
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def source_name(c, names: Mapping[str, str] = SOURCES) -> Column:
    """Without a leading day, and by its shown name where it has one; blank: Unknown."""
    s = F.regexp_replace(_text(c), r"^\d{2}_\d{2}_\d{4}_(?=.)", "")
    shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(_text(c) == "", "Unknown").otherwise(F.coalesce(F.element_at(shown, s), s))


def canonical_tech(c, known: Mapping[str, str]) -> Column:
    """The dictionary's spelling (by lower case), else all-capitals as they are, else each word with a capital."""
    s = F.trim(_text(c))
    shown = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k.lower(), v)])
    return F.coalesce(F.element_at(shown, F.lower(s)), F.when(s == F.upper(s), s).otherwise(F.initcap(s)))


def clean_entity(c) -> Column:
    """Without word-piece marks, edge punctuation and broken ends; empty below two bytes. Plain names, the most, need one
    look and none of the replacements."""
    c = F.col(c) if isinstance(c, str) else c
    plain = ~F.rlike(c, F.lit(rf"[^A-Za-z0-9 ]|^ | $|  | (?:{'|'.join(BAD_ENDS)})$")) & (F.octet_length(c) >= 2)
    s = _squeezed(F.regexp_replace(_text(c), "▁", ""))
    s = F.regexp_replace(s, r"""^[.,;:!?'"()\[\]{}<>«»]+|[.,;:!?'"()\[\]{}<>«»]+$""", "")
    cut = s
    for end in BAD_ENDS:
        cut = F.regexp_replace(cut, f" {end}$", "")
    return F.when(plain, c).when(F.octet_length(s) < 2, "").otherwise(F.trim(cut))


def title_for_classifier(c) -> Column:
    """Numbers, dates and shares by name, signs as spaces, lower case, single spaces; in this order."""
    s = _text(c)
    for pattern, to in ((r"\d+[.,]?\d*\s*%", "percent"), (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", "date"), (r"\d{1,2}[/-]\d{2,4}", "date"), (r"[Nn]ăm\s+\d{4}", "date"), (r"[Tt]háng\s+\d{1,2}", "date"), (r"[Qq]uý\s+\d", "date"), (r"\d+[.,]?\d*", "number"), (r"""[.,;:!?"'()\[\]{}\-–—…`]""", " ")):
        s = F.regexp_replace(s, pattern, to)
    return _squeezed(F.lower(s))


def job_token(title, level) -> Column:
    """Plain lower-case title and level as one token."""
    t = F.trim(F.regexp_replace(F.lower(_text(title)), "[^a-z0-9 ]", ""))
    lv = F.lower(_text(level))
    return F.concat_ws("_", t, F.when(lv == "", "unknown").otherwise(lv))


def expand_acronym(c, known: Mapping[str, str]) -> Column:
    """`SSH` as `SSH (Secure Shell)`; case counts, others stay."""
    full = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col(c))
    return F.when(full.isNotNull(), F.format_string("%s (%s)", F.col(c), full)).otherwise(F.col(c))


def alias_key(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(_text(c))), r"[\s._/\-]+", " "))


def slug(c) -> Column:
    return F.regexp_replace(F.translate(F.lower(_text(c)), " _", "--"), "[^a-z0-9-]", "")


def md5_id(url) -> Column:
    return F.md5(_text(url).cast("binary"))


def clipped(c, n: int, mark: str = "...") -> Column:
    s = _text(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(mark))).otherwise(s)


def passage(title, content, n: int = 1000) -> Column:
    return F.substring(F.trim(F.concat(_text(title), F.lit(" "), _text(content))), 1, n)


def array_literal(c) -> Column:
    """`["a","b"]` or `{a,b}` as an array of texts; anything else is empty."""
    s = F.trim(_text(c))
    braces = F.filter(F.transform(F.split(F.substring(s, 2, 1_000_000), ","), lambda x: F.trim(F.regexp_replace(x, r'[{}"]', ""))), lambda x: x != "")
    parsed = F.from_json(s, "array<string>")
    empty = F.array().cast("array<string>")
    return F.when(F.startswith(s, F.lit("{")), braces).when(F.startswith(s, F.lit("[")), F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), empty)).otherwise(empty)


def label_value(c, label: str, others: Sequence[str]) -> Column:
    """What stands behind `label:` up to the next of the other labels or the end, on one line."""
    stop = "|".join(others)
    return _squeezed(F.regexp_extract(_text(c), rf"(?isu){label}\s*[:–-]\s*(.*?)(?=\s*(?:{stop})\s*[:–-]|$)", 1))


def prefixed(c, kind: str) -> Column:
    return F.concat(F.lit(kind + ": "), _text(c))


def intent_terms(query, found: Column, rules: Mapping[str, str]) -> Column:
    """The found terms; where there are none, those of the rules whose pattern the query holds, each once."""
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(_text(query), F.lit("(?iu)" + p)), F.lit(t)) for p, t in rules.items()])))
    return F.when(F.size(found) > 0, found).otherwise(hits)


def profile_block(role, technologies: Column, location, bio) -> Column:
    """A line for each known part of a profile; empty if none is known."""
    def line(name, c):
        return F.when(_text(c) != "", F.concat(F.lit(f"- {name}: "), _text(c)))

    lines = F.array_compact(F.array(line("Vai trò", role), F.when(F.size(technologies) > 0, F.concat(F.lit("- Kỹ năng hiện có: "), F.array_join(technologies, ", "))), line("Địa điểm", location), line("Giới thiệu", bio)))
    return F.when(F.size(lines) > 0, F.concat(F.lit("Thông tin người dùng:\n"), F.array_join(lines, "\n"))).otherwise("")

