"""Patterns of dates and of pay, in order of precedence. Their results must be the same everywhere."""

DATES = (
    r"\b(ng[aà]y\s+\d{1,2}\s+th[aá]ng\s+\d{1,2}(?:\s+n[aă]m\s+\d{4})?)\b",
    r"\b(th[aá]ng\s+\d{1,2}(?:\s+n[aă]m\s+\d{4})?)\b",
    r"\b(Qu[yý]\s+(?:I{1,3}|IV|[1-4])(?:\s*/\s*\d{4})?)\b",
    r"\b(Q[1-4]\s*/\s*\d{4})\b",
    r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})\b",
    r"(?<!\d[/\-])(\d{1,2}[/\-]\d{4})(?!\d)",
    r"\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{4})\b",
    r"\b(?:n[aă]m|year)\s+((?:19|20)\d{2})\b",
    r"\b(Th[ứu]\s+(?:[2-7]|Hai|Ba|Tư|Năm|Sáu|B[aả]y))\b",
    r"\b(\d{1,2}/\d{1,2}(?:\s*[,và&]\s*\d{1,2}/\d{1,2})*)\b",
)
PAY = (
    r"\b(\d+(?:[,.]\d+)?\s*[-–]\s*\d+(?:[,.]\d+)?\s*tri[eệ]u(?:\s*VNĐ|\s*VND|\s*đồng)?)\b",
    r"\b(\d+(?:[,.]\d+)?\s*tri[eệ]u(?:\s*VNĐ|\s*VND|\s*đồng)?)\b",
    r"\b(upto\s+\d+(?:[,.]\d+)?(?:M|\s*tri[eệ]u|\s*VNĐ|\s*VND)?)\b",
    r"\b(up\s+to\s+\$?\d+(?:[,.]\d+)?(?:[,.]\d{3})*(?:\s*USD|\s*VND|\s*VNĐ|\s*tri[eệ]u)?)\b",
    r"\b(t[ừu]\s+\d+(?:[,.]\d+)?(?:\s*đến\s+\d+(?:[,.]\d+)?)?\s*tri[eệ]u(?:\s*VNĐ|\s*VND)?)\b",
    r"(\$\d{1,3}(?:,\d{3})*(?:\s*[-–]\s*\$\d{1,3}(?:,\d{3})*)?(?:\+)?(?:\s*USD|\s*VND|\s*VNĐ)?)",
    r"\b(\d{1,3}(?:[,.]\d{3})+(?:\s*VNĐ|\s*VND|\s*đồng|đ)?)\b",
    r"\b(\d+(?:[,.]\d+)?\s*\$\s*/\s*tháng)\b",
    r"(\$\s*\d{1,4}(?:\s*[-–]\s*\$?\s*\d{1,4})?(?:\s*USD|\s*VND)?)",
    r"\b(\d{1,2}\s*(?:–|-)?\s*\d{0,2}\s*tháng\s+lương(?:/năm)?)\b",
    r"\b(?:lương|thu\s+nhập|mức\s+lương|salary|income)\s+(\d+(?:[,.]\d+)?(?:\s*[-–]\s*\d+(?:[,.]\d+)?)?\s*(?:tri[eệ]u|nghìn|USD|VNĐ|VND)?)\b",
    r"\b(lương\s+(?:thương\s+lượng|cạnh\s+tranh|hấp\s+dẫn|theo\s+năng\s+lực|thoả\s+thuận|thỏa\s+thuận))\b",
    r"\b(thu\s+nhập\s+(?:cạnh\s+tranh|hấp\s+dẫn|theo\s+năng\s+lực))\b",
    r"\b(salary\s+(?:negotiable|competitive|attractive))\b",
    r"\b(competitive\s+salary(?:\s+range)?)\b",
)
