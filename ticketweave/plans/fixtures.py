"""Tickets and log lines that SQL derives from the ``events`` table, in text both engines can run."""

from __future__ import annotations

_PHRASES = [
    "Bonjour, suppression impossible du VLAN 120 sur DSLAM OP49MAB11 : erreur 1300. Merci d''avance",
    "code: 4002 retourné par SEBA lors de l''affectation ccl, port 12 occupé",
    "Problème de connextion ARTEMIS, timeout après 30 s. Cordialement",
    "ORA-12170 TNS timeout sur la base IPON, table non trouvé",
    "incohérence de données : double accès client, doublon détecté",
    "nd inconnu 0312345678 dans ADELIA, vérifier la déclaration svp",
    "lancement de script bloqué par deadlock detected sur ORCHESTRA",
    "compteur VLAN occupé à tort, purge à lancer",
    "please check the connection, error on the gateway 10.1.2.3 with delay",
    "mutation du lien annulé depuis la migration, err 42C",
    "B4002 erreur interne du serveur, configuration manquante",
    "dlm bloqué en cours, reprise impossible",
    "demande d''information sur le planning",
    "AVP 1300 : carte manquante au châssis, remplacement prévu",
]
_SOLUTIONS = ["", "Relancer le script puis vérifier la table", "Purger le compteur et supprimer le doublon",
              "Corriger la configuration du port"]
_CAUSES = ["DONNEES", "CONFIG RESEAU", "", "SCRIPT", "INTERFACE", "HABILITATION"]
_APPS = ["PORTAIL", "SEBA", "IPON", "ADELIA", ""]
_STATUS = ["Résolu", "closed", "En cours", "ouvert", "Clôturé"]
_PRIORITY = ["P1", "P2", "P3"]


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {arms} END"


TICKETS = {
    "ticket_id": "event_id", "user_id": "user_id", "event_type": "event_type", "value": "value", "created_at": "ts",
    "resume": _pick("event_id * 7 + user_id", _PHRASES),
    "sig": "concat('dossier D', event_id, ' contact j.martin CLI-', user_id + 10000)",
    "solution": _pick("user_id + event_id", _SOLUTIONS), "cause": _pick("user_id", _CAUSES),
    "application": _pick("user_id * 3 + event_id", _APPS), "status": _pick("event_id", _STATUS), "priority": _pick("event_id + 1", _PRIORITY),
}

_STAMP = "substr(cast(ts AS string), 1, 19)"
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' ELSE 'INFO' END"
_FORMATS = [
    f"concat('/opt/app/logs/connectorCL_', user_id % 5, '.log:', {_STAMP}, ',', 100 + event_id % 900, ' ', {_LEVEL}, ' [t-', user_id, '] c.app.Svc(42) - ', {TICKETS['resume']})",
    """concat('10.0.0.', user_id % 250, ' - - [05/Jan/2024:10:32:44 +0000] "GET /api/v2/items/', user_id, ' HTTP/1.1" ', CASE event_type WHEN 'error' THEN '500' WHEN 'view' THEN '404' ELSE '200' END, ' 1234')""",
    f"concat({_STAMP}, ' SEBAR_Create', event_id % 7, '=', event_id % 90, ',', (event_id % 90) * (event_id % 13000))",
    f"""concat('{{"time":"', {_STAMP}, '","level":"', event_type, '","service":"svc', user_id % 4, '","msg":"code: 4002 retour SEBA ', user_id, '","duration_ms":"', event_id % 500, 'ms","userId":"u', user_id, '"}}')""",
    f"concat({_STAMP}, ' ERROR ', CASE event_id % 3 WHEN 0 THEN 'no code here' ELSE concat('ORA-', 12000 + event_id % 40, ': TNS timeout') END)",
    f"concat({_STAMP}, ' ERROR [t-', user_id, '] transaction(7) - <transaction titre=', chr(39), 'Creation acces ', user_id % 6, chr(39), ' status=', chr(39), CASE event_id % 3 WHEN 0 THEN 'OK' ELSE 'KO' END, chr(39), '>')",
    """concat('com.acme.app.exception.', CASE user_id % 3 WHEN 0 THEN 'DslamUnreachableException' WHEN 1 THEN 'UnknownEptException' ELSE 'OtherFailureException' END, ': node NRA', 100 + user_id, ' port ', 10 + event_id % 40, ' id ', 1000000 + event_id)""",
    "concat('Caused by: java.lang.IllegalStateException at c.app.Svc.run', user_id % 3, '(Svc.java:', event_id % 90, ')')",
]
_FILES = ["errors_sample.log", "nginx.log", "solicitationstats_202401.log", "api.log", "oracle.log", "49mapp_transaction.log", "errors_sample.log", "errors_sample.log"]

LOG_LINES = {
    "line_id": "event_id", "event_type": "event_type", "user_id": "user_id", "ts": "ts", "file_name": _pick("event_id", _FILES),
    "line": "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMATS)) + " END",
}


def columns(spec: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in spec.items()]


def expand(sql: str) -> str:
    """Replace ``$tickets`` and ``$log_lines`` by sub-selects over ``events``."""
    for mark, spec in (("$tickets", TICKETS), ("$log_lines", LOG_LINES)):
        sql = sql.replace(mark, "(SELECT " + ", ".join(columns(spec)) + " FROM events)")
    return decimal_rounding(sql)


def decimal_rounding(sql: str) -> str:
    """Make every ``round(x, n)`` round the shortest decimal form of a double, as Spark does, instead of x * 10^n."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        if j and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            c = sql[k]
            depth += (c == "(") - (c == ")")
            comma = k if c == "," and depth == 1 else comma
            k += 1
        inner, digits = decimal_rounding(sql[j + 6:comma]), sql[comma + 1:k - 1].strip()
        out.append(f"{sql[i:j]}CAST(round(CAST(CAST(({inner}) AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)")
        i = k
    return "".join(out) + sql[i:]
