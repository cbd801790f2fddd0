"""Audit settings, their JSON store, and the fixed vocabularies of the checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

# Roles in display and matching order, each with its column keywords.
ROLE_KEYWORDS: dict[str, list[str]] = {
    "Ticket Identification": [
        "number", "ticket_id", "ticket_number", "incident_number", "request_number", "case_id", "case_number", "sys_id",
        "inc_number", "sr_number", "cr_number", "ritm_number", "ticket_no", "incident_id", "request_id", "case_no",
        "reference", "ref_number", "ref_no", "ticket_ref",
    ],
    "Assignment Group": [
        "assignment_group", "assigned_group", "support_group", "resolver_group", "assigned_to_group", "team",
        "group_name", "support_team", "resolver_team", "owning_group", "owner_group", "responsible_group",
    ],
    "Configuration Item": [
        "cmdb_ci", "ci_name", "configuration_item", "affected_ci", "service_ci", "business_service",
        "service_name", "application", "app_name", "system", "component", "service_offering",
    ],
    "Priority": ["priority", "urgency", "severity", "impact", "priority_level", "sla_priority", "ticket_priority"],
    "State/Status": [
        "state", "status", "incident_state", "ticket_state", "current_state", "workflow_state", "ticket_status",
        "request_state", "case_status", "resolution_status",
    ],
    "Created": [
        "opened_at", "created", "created_at", "created_date", "open_date", "creation_date", "sys_created_on",
        "submitted_date", "reported_date", "raised_date", "logged_date", "opened_date", "start_date", "raised_on",
    ],
    "Closed": [
        "resolved_at", "closed_at", "closed", "resolved", "close_date", "resolution_date", "closed_date",
        "completed_date", "completion_date", "end_date", "resolved_date", "closure_date", "closed_on",
    ],
    "Short Description": [
        "short_description", "title", "subject", "summary", "brief", "headline", "short_desc", "issue_title",
        "ticket_title", "problem_summary",
    ],
    "Description": [
        "description", "long_description", "details", "notes", "full_description", "issue_description",
        "problem_description", "ticket_description", "request_description", "comments",
    ],
}

# What ticket ids look like, besides plain digits.
ID_PREFIXES = ["INC", "CR", "SR", "RITM", "CHG", "PRB", "REQ", "TASK", "CTASK", "SCTASK", "TKT", "CASE", "IM", "SD", "HDT", "WO"]

# What the values of two roles look like (case-insensitive).
VALUE_PATTERNS: dict[str, list[str]] = {
    "Priority": [r"^P[1-5]$", r"^[1-5]$", r"^(Critical|High|Medium|Low|Very Low)$", r"^(Urgent|Normal|Low)$"],
    "State/Status": [
        r"^(New|Open|In Progress|Pending|Resolved|Closed|Cancelled)$",
        r"^(Active|Inactive|On Hold|Assigned|Work in Progress)$",
        r"^[1-8]$",
    ],
}

# Names that cannot hold a role, matched from the start of the normalised name.
EXCLUDED_NAMES: dict[str, list[str]] = {
    "Ticket Identification": [r".*state.*", r".*status.*", r".*description.*", r".*group.*", r".*date.*", r".*priority.*"],
    "Configuration Item": [r".*state.*", r".*status.*", r".*incident.*(?!.*ci)", r".*parent.*", r".*child.*"],
}

# Words that say a state is closed, or open; closed is looked for first.
TERMINAL_WORDS = ["closed", "resolved", "completed", "cancelled", "canceled", "done", "solved", "close", "complete", "cancel", "fulfilled"]
ACTIVE_WORDS = ["open", "new", "active", "pending", "assigned", "awaiting", "hold", "wip", "acknowledged", "investigating", "reopened", "progress"]
NO_STATE = ["", "nan", "none", "<na>"]

# Words that carry no meaning when descriptions are compared.
STOP_WORDS = """
about after again also another back because been before being both cannot come could does doing done down during each
even ever every from getting give goes going gone have having here into just know like made make many more most much
must need needs only other over please same seems shall should since some still such than that their them then there
these they thing this those through time trying under until upon used using very want well were what when where which
while will with within without would your yours
team hello dear thanks thank regards kindly ticket incident request issue user customer
""".split()

# Text that is removed before comparison or detection, in this order;
# (pattern, is case ignored). The last one squeezes white space.
CLEAN_PATTERNS: list[tuple[str, bool]] = [
    (r"\b(INC|CHG|REQ|PRB|RITM|TASK|KB|SCTASK|SR|CR|WO|JIRA)\d+\b", True),
    (r"\b[A-Z]{2,}[0-9]+[A-Z0-9]*\b", False),
    (r"\b[0-9]+[A-Z]+[A-Z0-9]*\b", False),
    (r"\b[A-Z]{3,}[0-9A-Z]*\d+[A-Z0-9]*\b", False),
    (r"\S+@\S+\.\S+", False),
    (r"https?://\S+", False),
    (r"www\.\S+", False),
    (r"[A-Za-z]:\\[\w\\.\-]+", False),
    (r"/[\w/.\-]+\.\w+", False),
    (r"\[[A-Z0-9_\s\-]+\]", True),
    (r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b", False),
    (r"\b\d+\b", False),
    (r"\b(SAP|ERP|CRM|API|SQL|HTML|XML|JSON|PDF|CSV)\b", True),
]

# Letters that give a language away, first match wins.
SCRIPT_CLASSES: list[tuple[str, str]] = [
    ("French", "[àâçéèêëîïôùûœæ]"),
    ("German", "[äöüß]"),
    ("Spanish", "[ñ¿¡áéíóúü]"),
    ("Italian", "[àèìòùé]"),
    ("Portuguese", "[ãõçáéíóúâêô]"),
    ("Polish", "[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]"),
    ("Czech", "[ěščřžýůúíďťňĚŠČŘŽÝŮÚÍĎŤŇ]"),
    ("Hungarian", "[őűŐŰ]"),
    ("Turkish", "[şğıİŞĞ]"),
    ("Romanian", "[ăâîșțĂÂÎȘȚ]"),
    ("Russian", "[а-яА-ЯёЁ]"),
    ("Ukrainian", "[іїєґІЇЄҐ]"),
    ("Greek", "[Ͱ-Ͽ]"),
    ("Chinese", "[一-鿿]"),
    ("Japanese", "[぀-ゟ゠-ヿ一-鿿]"),
    ("Korean", "[가-힯ᄀ-ᇿ]"),
    ("Arabic", "[؀-ۿ]"),
    ("Hebrew", "[֐-׿]"),
    ("Thai", "[฀-๿]"),
    ("Vietnamese", "[àảãáạăằẳẵắặâầẩẫấậèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵđ]"),
]

# Words that give a language away; two different ones are needed, in this order of languages.
LANGUAGE_WORDS: dict[str, list[str]] = {
    "Portuguese": """
        nao estao esta sao por uma mas ou migrando obsolescencia obsolecencia saldo diferencas localidade unidade
        departamento precisa ajuda nome telefone para quando onde qual quem porque consigo acessar consta tentar
        utilizar nem pois erro ao contato seguros""".split(),
    "Spanish": """
        diferencias erronea asignacion almacen usuario reporta detecto numeros consignacion quedando material apoyar
        nuevamente hola buenos dias gracias como puede dar baja pueden sistema problemas problema eliminar capa cuando
        renuevo contrato aparece notifico permite realizar error en para una no solicita favor cuenta correo mensaje
        datos numero equipo archivo fecha nombre cliente solicitud informacion pago factura donde cual quien tambien
        ahora esta pero solo momento abrir aplicativo ingresar aplicacion arroja darle aparecen errores figura
        transmitir reversada rebookeada reverse unas duplico reversa mercados duplicados duplicadas cuotas detaladas
        mercado intentar grabar cambios finalizar sigue aparecciendo estoy intentando sale pantalla negra coinciden
        montos ingresados calculados solicito recibe incompleto puedo ingreso nuevo colega al el los las me se que""".split(),
    "French": """
        bonjour comment merci pour avec sont pas une les vous nous qui c'est je tu fonctionne depuis matin probleme
        systeme francais pourquoi quand oui non aussi maintenant toujours peut faire doit""".split(),
}

# Orders and limits of reports.
RESULT_ORDER = ["Fail", "Not checked", "Review", "Pass"]
SEVERITY_ORDER = ["Critical", "High", "Medium", "Low", "-"]
TIER_WEIGHTS = {"Critical": 0, "Poor": 25, "Fair": 50, "Good": 80, "Excellent": 100}
FLAG_LABELS = {
    "closed_before_created": "Closed Before Created",
    "future_created": "Future Created Date",
    "future_closed": "Future Closed Date",
    "closed_no_date": "Closed No Date",
    "open_with_date": "Open With Date",
    "open_missing_priority": "Open Missing Priority",
}
RARE_SHARE, RARE_COUNT, NEAR_RATIO, NEAR_LIMIT = 1.0, 5, 0.85, 200
ROLE_THRESHOLD, VALUE_SAMPLE, DATE_SAMPLE = 30, 100, 10
JACCARD, LEAST_TOKENS, TOP_GROUPS, SAMPLE_IDS = 0.6, 3, 25, 5
EDGE_DAYS, GAP_DAYS, MONTHS_SPELLED = 3, 7, 4
EXPAND_LIMIT, TOP_VALUES, CUBE_DIMENSIONS, CUBE_DISTINCT, CUBE_ROWS, MIX_TOP = 50, 20, 4, 50, 5000, 6
PASS_MARK, SHEET_ROWS, CELL_CHARS, SLOW_CELLS, INLINE_ROWS = 65, 1_048_576, 32_767, 1_000_000, 100_000
ABSENT = "__absent__"


@dataclass(frozen=True)
class AuditConfig:
    """Settings of an audit; anything a file holds beyond these is kept by the store."""

    null_threshold: float = 20
    desc_min_length: int = 20
    desc_max_length: int = 5000
    report_native_pivots: bool = True
    column_overrides: dict = field(default_factory=dict)
    date_dayfirst: bool | None = None
    extract_columns: list = field(default_factory=list)
    extract_date_column: str | None = None
    extract_format: str = "xlsx"
    extract_month_mode: str = "range"
    extract_exclude_cancelled: bool = False


class ConfigStore:
    """Defaults overlaid by a JSON file; a missing or malformed file means defaults."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.values = asdict(AuditConfig())
        try:
            loaded = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            loaded = {}
        if isinstance(loaded, dict):
            self.values |= loaded

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def set(self, key: str, value) -> None:
        self.update({key: value})

    def update(self, values: dict) -> None:
        self.values |= values
        self.save()

    def save(self) -> None:
        self.path.write_text(json.dumps(self.values, indent=2), encoding="utf-8")

    def config(self) -> AuditConfig:
        known = {f.name for f in fields(AuditConfig)}
        return replace(AuditConfig(), **{k: v for k, v in self.values.items() if k in known})
