"""The table of code rules that texts are scanned with."""

from __future__ import annotations

_SCRIPT, _TYPED = ("javascript", "typescript"), ("typescript",)
_BOTH = ("javascript", "typescript", "python")

# Id, severity, languages and pattern of each rule. Repeats in look-behinds are bounded, as Java asks for.
RULES = [
    ("AP-001", "high", ("javascript", "typescript", "java"), r"catch\s*\([^)]*\)\s*\{\s*\}"),
    ("AP-002", "medium", _SCRIPT, r"catch\s*\([^)]*\)\s*\{[^}]*console\.(log|error)\([^)]*\)[^}]*\}"),
    ("AP-003", "low", _BOTH, r"(?<!(const|let|var|\w{1,64}=)|test\.)\b(100|200|404|500|1000|3600|86400)\b"),
    ("AP-005", "low", _SCRIPT, r"(?:const|let|var)\s+(\w+)\s*=(?!.*\1)"),
    ("AP-006", "medium", _SCRIPT, r"console\.log\s*\("),
    ("AP-007", "low", _BOTH, r"//\s*TODO|#\s*TODO"),
    ("AP-008", "medium", _SCRIPT, r"function\s+\w+\s*\([^)]*\)\s*\{[\s\S]{500,}?\}"),
    ("AP-009", "high", _BOTH, r"if\s*\([^)]+\)\s*\{[^}]*if\s*\([^)]+\)\s*\{[^}]*if\s*\([^)]+\)\s*\{[^}]*if"),
    ("AP-010", "medium", _SCRIPT, r"(?:const|let)\s+\w+\s*=\s*\{[^}]+\};[\s\S]{0,100}(?:const|let)\s+\w+\s*=\s*\{[^}]+\};"),
    ("AP-011", "high", _SCRIPT, r"function\s+\w+\s*\(\s*(\w+)\s*\)\s*\{(?!.*(?:if|throw|assert|validate))"),
    ("AP-012", "high", _SCRIPT, r"\([^)]*\)\s*=>\s*\{[^}]*\([^)]*\)\s*=>\s*\{[^}]*\([^)]*\)\s*=>"),
    ("AP-013", "low", _SCRIPT, r"import\s+\{?\s*(\w+)\s*\}?\s+from(?!.*\1)"),
    ("AP-014", "low", _SCRIPT, r"(?:const|let|var)\s+([a-z]+_[a-z]+)\s*="),
    ("AP-015", "medium", _TYPED, r"function\s+\w+\s*\([^)]*\)\s*\{"),
    ("AP-016", "high", _TYPED, r":\s*any\b"),
    ("AP-017", "medium", _SCRIPT, r"fs\.(readFileSync|writeFileSync|existsSync)"),
    ("AP-018", "medium", _SCRIPT, r"(?<!dynamic\(\s{0,8}\(\)\s{0,8}=>\s{0,8})(?<!import\([^)]{1,200}\)\.)\b(?!import\b)\w+\([^)]*\)\.then\("),
    ("AP-019", "high", ("python",), r"except\s*:"),
    ("AP-020", "high", ("python",), r"def\s+\w+\s*\([^)]*=\s*(?:\[\]|\{\})"),
    ("AP-021", "high", ("python",), r"global\s+\w+"),
    ("AP-022", "medium", _SCRIPT, r"for\s*\([^)]+\)\s*\{[^}]*\w+\s*\+=\s*['\"]"),
    ("AP-023", "medium", _SCRIPT, r"class\s+(?!ErrorBoundary)\w+\s+extends\s+(?:React\.)?Component(?!.*componentDidCatch)"),
    ("AP-024", "medium", _SCRIPT, r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*useState[^}]*\}(?!.*useMemo|useCallback)"),
    ("AP-025", "high", _SCRIPT, r"useEffect\s*\(\s*\(\)\s*=>\s*\{[^}]*\w+[^}]*\},\s*\[\s*\]"),
]
