"""Word lists, patterns, weights and thresholds that results depend on."""

# ---------------------------------------------------------------- levels, systems, codes
LOG_LEVEL_ORDER = ["ERROR", "FATAL", "CRITICAL", "WARN", "WARNING", "INFO", "DEBUG"]
UPSTREAM_SYSTEMS = ["SEBA", "ARTEMIS", "IPON", "ADELIA", "SCA", "ORCHESTRA"]
NULL_SPELLINGS = ["-", "Inconnu", "Inconnue", "Not Specified", "0", "", "NA", "null", "None"]

# Patterns of error codes per variant: (pattern, capture group)
ERROR_CODE_PATTERNS = {
    "log": [
        (r"(?i)\b(B\d{4})\b", 1), (r"(?i)\bERREUR?\s+(\d{3,5})\b", 1), (r"(?i)\bcode[:\s]+(\d{3,5})\b", 1),
        (r"(?i)\b(ORA-\d{4,6})\b", 1), (r"(?i)\b(AVP[-\s]?\d+)\b", 1), (r"(?i)\b(42C)\b", 1),
        (r"(?i)\b(1300|9903|1002|4002|42C|300|327|1583)\b", 1),
    ],
    "ticket": [(r"\b(\d{4})\b", 1), (r"\b(B\d{4})\b", 1), (r"\b(42C)\b", 1), (r"(ORA-\d+)", 1)],
    "text": [
        (r"(?i)\bB\d{4}\b", 0), (r"(?i)\bAVP[-\s]?\d+\b", 0), (r"(?i)\bORA-\d{4,6}\b", 0),
        (r"(?i)\bERR(?:EUR)?[-_\s]?\d+\b", 0), (r"(?i)\b\d{3,5}\b", 0),
        (r"(?i)\b[A-Z]{2,4}[-_]\d{2,6}\b", 0), (r"(?i)\b42C\b", 0),
    ],
}
KNOWN_TICKET_CODES = ["1300", "9903", "1002", "42C", "B4002", "4002", "300", "327", "1583", "135", "136"]

# ---------------------------------------------------------------- ticket categories, first match wins
TICKET_CATEGORIES = [
    ("Suppression_Impossible", ["suppression impossible", "impossible de supprimer", "ne peut pas supprimer",
                                "suppression nd", "suppression dslam", "suppression vlan", "suppression bas",
                                "suppression routeur", "suppression operateur", "suppression carte"]),
    ("Erreur_1300", ["1300", "erreur 1300", "type 1300"]),
    ("VLAN_Blocked", ["vlan bloqué", "vlan occupé", "vlan impossible", "vlan occupe"]),
    ("Double_Access", ["double accès", "double access", "double déclaration", "double declaration"]),
    ("ND_Unknown", ["nd inconnu", "nd introuvable", "nd absent", "noeud inconnu", "nd ftth", "nd adsl"]),
    ("DSLAM_Error", ["dslam", "recherche de broche", "compteurs dslam", "broche en echec"]),
    ("Card_Error", ["carte impossible", "suppression carte", "carte manquante", "changement de modele"]),
    ("Counter_Error", ["compteur", "ressource logique", "vc vp", "vlan occupé à tort", "occupe a tort"]),
    ("IHM_Error", ["ihm bloquée", "ihm bloquee", "script bloqué", "lancement de script", "ihm lancement"]),
    ("Internal_Error", ["internal error", "b4002", "erreur interne"]),
    ("Data_Inconsistency", ["incohérence", "incoherence", "données incorrectes", "donnees incorrectes",
                            "incoherence de donnees", "correction de donnees", "caracteres errones"]),
    ("Configuration_Error", ["configuration", "configurer", "erreur de format", "champ obligatoire",
                             "format incorrect", "nifolder"]),
    ("Mutation_Lien", ["mutation", "mouvement bbc", "mouvement umiepc", "transfert"]),
    ("Affectation_Error", ["affectation", "err 42c", "ccl", "vc deja occupe", "affectation thd"]),
    ("DLM_Blocked", ["dlm bloqué", "dlm bloque", "dlm en cours", "reprise dlm"]),
]
DEFAULT_CATEGORY = "Autre"
RESOLVED_STATUS_WORDS = ["résolu", "closed", "done", "fermé", "resolved", "clos", "clôturé", "cloture"]

# ---------------------------------------------------------------- issue status buckets
STATUS_BUCKETS = {
    "open": ["Open", "To Do", "Backlog", "New"],
    "in_progress": ["In Progress", "In Development", "In Review", "Analysing", "Ready for test", "Ready for delivery"],
    "resolved": ["Resolved", "Done"],
    "closed": ["Closed", "Completed", "Cancelled"],
}

# ---------------------------------------------------------------- keyword extraction
KEYWORD_STOP_WORDS = [
    "le", "la", "les", "de", "du", "un", "une", "des", "est", "sur", "dans", "par", "en", "pour", "avec", "que",
    "qui", "pas", "ne", "au", "aux", "ce", "se", "si", "il", "elle", "ils", "elles", "nous", "vous", "je", "tu",
    "son", "sa", "ses", "mon", "ma", "et", "ou", "mais", "donc", "or", "ni", "car", "nan", "none", "null", "true",
    "false",
]
KEYWORD_PATTERN = r"[a-záàâäéèêëîïôùûüç_]{3,}"

# ---------------------------------------------------------------- actions recommended by frequency
PATTERN_ACTIONS = [
    (20, 0.60, "Créer une procédure canonique (fréquence élevée)"),
    (5, 0.50, "Ajouter au cluster existant ou créer un cluster"),
    (0, 0.35, "Surveiller — fréquence trop faible pour clustering"),
]

# ---------------------------------------------------------------- ticket text clean-up
NOISE_PHRASES = [
    r"bonjour[,\s]*", r"bonsoir[,\s]*", r"salut[,\s]*", r"monsieur[,\s]*", r"madame[,\s]*", r"cordialement[,\s]*",
    r"merci[,\s]*d['e]\s*avance[,\s]*", r"merci[,\s]*", r"svp[,\s]*", r"stp[,\s]*", r"s'il vous plaît[,\s]*",
    r"s'il te plaît[,\s]*", r"bonne journée[,\s]*", r"bonne soirée[,\s]*", r"au revoir[,\s]*", r"cdlt[,\s]*",
]
TYPO_MAP = {
    "suprimmer": "supprimer", "supprimmer": "supprimer", "suprimer": "supprimer", "erruer": "erreur",
    "eurreur": "erreur", "connextion": "connexion", "connexion": "connexion", "blokage": "blocage",
    "bloquage": "blocage", "immpossible": "impossible", "imposible": "impossible", "anulation": "annulation",
    "anulé": "annulé", "créacion": "création", "creaction": "création", "verifier": "vérifier",
    "verifié": "vérifié", "lancer": "lancer", "configurer": "configurer", "seba": "SEBA", "ipon": "IPON",
    "artemis": "ARTEMIS", "adelia": "ADELIA", "orchestra": "ORCHESTRA", "sca": "SCA",
}
GLOSSARY = {
    "supp": "suppression", "err": "erreur", "pb": "problème", "config": "configuration", "ko": "hors service",
    "ok": "opérationnel", "maj": "mise à jour", "k.o.": "hors service",
}
FRENCH_WORDS = [
    "erreur", "impossible", "supprimer", "blocage", "connexion", "commande", "lancer", "vérifier", "création",
    "problème", "merci", "bonjour", "svp", "le", "la", "les", "de", "du", "annulé", "depuis", "dans", "sur", "avec",
    "une", "un",
]
ENGLISH_WORDS = [
    "error", "cannot", "delete", "block", "connection", "command", "launch", "check", "create", "problem", "please",
    "hello", "the", "is", "are", "was", "on", "with",
]

# ---------------------------------------------------------------- model text normaliser, in this order
ML_NOISE = [r"https?://\S+", r"\S+@\S+\.\S+", r"<[^>]+>", r"\[.*?\]", r"={3,}|-{3,}|\*{3,}"]
ML_ERROR_CODES = [
    (r"(?i)\b(?:erreur|error|err\.?)\s*:?\s*(\d{3,5})\b", r"ERROR_CODE_$1"),
    (r"\bB-?(\d{4})\b", r"ERROR_CODE_B$1"),
    (r"(?i)\bORA-(\d{4,5})\b", r"ERROR_ORA_$1"),
    (r"(?:^|[\s\(\[\"])(\d{4,5})(?:[\s\)\]\"]|$)", r" ERROR_CODE_$1 "),
    (r"(?i)\bcode\s*:?\s*(\d{3,5})\b", r"ERROR_CODE_$1"),
]
ML_EQUIPMENT = [
    (r"(?i)\b(?:NRO|NRA|OLT|DSLAM|SEBA|FTTH)-[A-Z0-9](?:[A-Z0-9\-]{2,20})\b", "EQUIPMENT_ID"),
    (r"\b[A-Z]{2,4}\d{2}[A-Z]{2,4}\d{1,4}\b", "EQUIPMENT_ID"),
    (r"\b\d{1,2}/\d{1,2}/\d{1,2}\b", "PORT_ID"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_ADDRESS"),
    (r"(?i)\bvlan\s*(\d{1,4})\b", r"VLAN_$1"),
    (r"(?i)\bnd\s*(\d{10})\b", "ND_NUMBER"),
]
ML_SYNONYMS = {
    "annulé": "annule", "annulée": "annule", "incohérence": "incoherence", "cohérence": "coherence",
    "doublons": "doublon", "supprimé": "supprime", "supprimée": "supprime", "bloqué": "bloque", "bloquée": "bloque",
    "habilitations": "habilitation", "défaut": "defaut", "correction": "corriger", "corrigé": "corriger",
    "corrigée": "corriger", "configuration": "configurer", "configuré": "configurer",
}
ML_STOP_WORDS = [
    "le", "la", "les", "un", "une", "des", "du", "de", "d", "l", "ce", "cet", "cette", "ces", "mon", "ton", "son",
    "ma", "ta", "sa", "mes", "tes", "ses", "notre", "votre", "leur", "nos", "vos", "leurs", "il", "elle", "ils",
    "elles", "je", "tu", "nous", "vous", "on", "me", "te", "se", "lui", "y", "en", "et", "ou", "ni", "mais", "donc",
    "or", "car", "que", "qui", "pour", "par", "sur", "sous", "dans", "avec", "sans", "entre", "vers", "depuis",
    "pendant", "avant", "après", "lors", "dès", "au", "aux", "à", "chez", "est", "sont", "a", "ont", "était",
    "étaient", "avait", "avaient", "sera", "seront", "aura", "auront", "peut", "peuvent", "doit", "doivent", "fait",
    "font", "ne", "pas", "plus", "très", "bien", "aussi", "encore", "déjà", "puis", "ainsi", "alors", "quand", "si",
    "ticket", "incident", "demande", "cas", "problème", "probleme", "issue", "sujet", "objet", "titre",
]

# ---------------------------------------------------------------- entities: type -> patterns (capture group 1)
ENTITY_PATTERNS = {
    "equipment_id": [r"(?i)\b([A-Z]{2,5}[A-Z0-9]{2,4}\d{3,6})\b", r"(?i)\b(NRO[-\s]?[A-Z0-9]{3,12})\b",
                     r"(?i)\b(SRO[-\s]?[A-Z0-9]{3,12})\b", r"(?i)\b(OLT[-\s]?[A-Z0-9]{3,12})\b",
                     r"(?i)\b(OND[-\s]?[A-Z0-9]{3,12})\b", r"(?i)\b(BAS[-\s]?[A-Z0-9]{3,12})\b"],
    "telecom_node": [r"(?i)\b(avp)\b", r"(?i)\b(nro)\b", r"(?i)\b(olt)\b", r"(?i)\b(sro)\b", r"(?i)\b(ond)\b", r"(?i)\b(sl)\b"],
    "user_id": [r"(?i)\b([a-z]\.[a-z]{2,20})\b", r"(?i)\butilisateur\s+([A-Z0-9_\-]{4,20})\b", r"(?i)\buser\s+([A-Z0-9_\-]{4,20})\b"],
    "appointment_ref": [r"(?i)\bRDV[-\s]?(\d{6,12})\b", r"(?i)\brendez-vous\s+(\d{6,12})\b"],
    "constraint_code": [r"(?i)\b(AVP[-\s]?\d+)\b", r"(?i)\b(1300|9903|42C)\b"],
}
ENTITY_CONFIDENCE = {"error_code": 0.95, "action_verb": 0.90, "system_name": 0.99}
DEFAULT_ENTITY_CONFIDENCE = 0.80
ACTION_VERBS = ["supprimer", "créer", "modifier", "lancer", "vérifier", "annuler", "relancer", "configurer", "démarrer", "arrêter"]
SYSTEM_ALIASES = {
    "SEBA": ["seba"], "ARTEMIS": ["artemis"], "IPON": ["ipon"], "ADELIA": ["adelia", "adélia"], "SCA": ["sca"],
    "ORCHESTRA": ["orchestra", "orchestration"], "NRO": ["nro"], "OLT": ["olt"], "SRO": ["sro"], "OND": ["ond"],
    "SL": ["sl ", " sl"], "AVP": ["avp"],
}

# ---------------------------------------------------------------- canonical error codes: (pattern, group, prefix, confidence)
CANONICAL_CODES = [
    (r"(?i)\bB(\d{4})\b", 1, "B", 0.99), (r"(?i)\bAVP[-\s]?(\d{3,6})\b", 1, "AVP", 0.99),
    (r"(?i)\bORA[-\s](\d{4,6})\b", 1, "ORA-", 0.99), (r"(?i)\bERR(?:EUR)?[-_\s]?(\d{1,6}[A-Z]?)\b", 1, "ERR", 0.95),
    (r"(?i)\bBR[-\s](\d{3,6})\b", 1, "BR-", 0.95), (r"(?i)\b([A-Z]{2,4}[-_]\d{3,6})\b", 1, "", 0.88),
    (r"(?i)\b42C\b", 0, "", 0.99), (r"\b(9903)\b", 1, "", 0.95), (r"\b(1300)\b", 1, "", 0.92), (r"\b(4002)\b", 1, "", 0.92),
    (r"\b(1002)\b", 1, "", 0.90), (r"\b(1203)\b", 1, "", 0.90), (r"\b(2025)\b", 1, "", 0.85), (r"\b(2930)\b", 1, "", 0.85),
    (r"\b(\d{4})\b", 1, "", 0.70), (r"\b(\d{3})\b", 1, "", 0.60),
]
YEAR_PATTERN = r"^(19|20)\d{2}$"

# ---------------------------------------------------------------- log message templates, in this order
TEMPLATE_VARIABLES = [
    (r"(?i)\b([A-Z]{3,5}[A-Z0-9]{2,4}\d{2,6})\b", "<EQUIPMENT_ID>"),
    (r"(?i)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP_ADDRESS>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"(?i)\b\d{6,}\b", "<NUMERIC_ID>"),
    (r"(?i)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"(?i)\bERREUR?\s+\d{3,5}\b", "<ERROR_CODE>"),
    (r"(?i)/[\w./\-_]+\.\w{2,4}", "<FILE_PATH>"),
    (r"(?i)\bport\s+\d{2,5}\b", "<PORT>"),
]

# ---------------------------------------------------------------- personal data, in this order: (prefix, pattern)
PII_PATTERNS = [
    ("ND", r"(?i)\bND[-_]?\d{4,10}\b"),
    ("CMD", r"(?i)\b(?:CMD|ORD|ORDER|COMMANDE)[-_]?\d{4,12}\b"),
    ("CLIENT", r"(?i)\bCLI?[-_]?\d{4,10}\b"),
    ("IP", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("IPV6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"),
    ("MAC", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b"),
    ("NRO", r"(?i)\bNR[OA][-_]?[A-Z0-9]{2,12}\b"),
    ("DSLAM", r"\b[A-Z]{3,5}\d{2,4}[A-Z]?\b"),
    ("AGENT", r"\b[a-z]{1,3}\.[a-z]{2,20}\b"),
    ("PHONE", r"\b(?:\+33|0033|0)[1-9](?:[ .\-]?\d{2}){4}\b"),
]

# ---------------------------------------------------------------- exceptions: class -> short code, then message rules
EXCEPTION_SHORT = {
    "DslamClosedForProductionException": "DSLAM_CLOSED", "UnknownMRTIdException": "UNKNOWN_MRT",
    "AvailableNetworkResourcesDisallowProductionException": "NET_DISALLOW",
    "DslamUnreachableException": "DSLAM_UNREACHABLE", "DslamNotFoundException": "DSLAM_NOT_FOUND",
    "CommandValidationException": "CMD_VALIDATION", "BusinessRuleViolationException": "BIZ_RULE",
    "BusinessRuleException": "BIZ_RULE", "ConnectorUnavailableException": "CONNECTOR_KO",
    "IntegrationTimeoutException": "INT_TIMEOUT", "SessionExpiredException": "SESSION_EXP",
    "ProvisioningTimeoutException": "PROV_TIMEOUT", "IdCrcMrtAlreadyUseException": "MRT_DUPLICATE",
    "DslamAccessMrtFunctionalException": "MRT_NOT_FOUND", "CclNotFoundForCEVOfferException": "CCL_NOT_FOUND",
    "UnknownEptException": "UNKNOWN_EPT", "EptAlreadyExistsException": "EPT_DUPLICATE",
}
MESSAGE_RULES = [
    (r"accès client existe déjà|mrtchemin déjà porté", "MRT_DUPLICATE"),
    (r"macro ressource technique .+ inconnu", "UNKNOWN_MRT"),
    (r"mrt access dslam ne correspond", "MRT_NOT_FOUND"),
    (r"dslam .+ closed for production|fermé à la production", "DSLAM_CLOSED"),
    (r"card .+ closed for production|carte .+ fermée", "DSLAM_CLOSED"),
    (r"dslam .+ (inaccessible|unreachable|joignable)", "DSLAM_UNREACHABLE"),
    (r"ressources? réseau .+ interdit|disallow.+production", "NET_DISALLOW"),
    (r"règle métier|businessrule|règle de gestion", "BIZ_RULE"),
    (r"connecteur .+ indisponible|connector .+ unavailable", "CONNECTOR_KO"),
    (r"timeout|délai.?dépassé|time.?out", "INT_TIMEOUT"),
    (r"session .+(expir|invalid|expiré)", "SESSION_EXP"),
    (r"echec de la recherche de broche", "DSLAM_CLOSED"),
    (r"transaction .* status.*ko|rapporttransaction.*ko", "TRANSACTION_KO"),
    (r"resources not found for following techservicefunction", "TSF_NOT_FOUND"),
    (r"techservicefunction.*(not found|introuvable|inexistant)", "TSF_NOT_FOUND"),
    (r"not found|introuvable|non trouvé", "RESOURCE_NOT_FOUND"),
    (r"already exists|déjà existant|déjà créé", "DUPLICATE_RESOURCE"),
    (r"validation (error|fail|échoue)", "CMD_VALIDATION"),
    (r"provisioning.*(fail|error|échec)|échec.*(provisioning|provisionn)", "PROV_FAILURE"),
    (r"équipement ne permet pas la production|ne peut pas être mis en production", "EQUIP_PROD_BLOCKED"),
    (r"services? cibles?.*(impossible|interdit|bloqué)|production.*bloquée", "EQUIP_PROD_BLOCKED"),
    (r"vlan .+ déjà existant|vlan.*already", "VLAN_DUPLICATE"),
    (r"port.*(occupé|already used|déjà utilisé)", "PORT_CONFLICT"),
    (r"broche.*(non trouvé|introuvable|not found)|no port found|aucune broche", "PORT_NOT_FOUND"),
    (r"erreur.*commande|command.*error|échec.*commande", "CMD_ERROR"),
    (r"identifiant de dossier de réalisation .+ inconnu|dossier.*(inconnu|not found)", "DOSSIER_NOT_FOUND"),
    (r"numeroccl est obligatoire|ccl.*(manquant|obligatoire|requis)", "CCL_NOT_FOUND"),
    (r"deadlock detected|lockacquisitionexception|caused by:.*deadlock", "DB_DEADLOCK"),
    (r"current transaction is aborted|commands ignored until end of transaction", "DB_DEADLOCK"),
    (r"psqlexception|postgresql.*error|hibernate.*exception|caused by:.*psqlexception", "DB_ERROR"),
    (r"vlan .+ n'existe pas|vlan.*(inexistant|not found|fermé)", "VLAN_NOT_FOUND"),
    (r"tst list not supported|not supported by dslam", "DSLAM_CAPABILITY"),
    (r"identifiant d'epc .+ déjà utilisé|epc.*(duplicate|doublon|déjà)", "EPC_DUPLICATE"),
    (r"déjà utilisé|already in use|doublon|duplicate", "DUPLICATE_RESOURCE"),
    (r"accès est déjà en cours de modification|dossier en cours|accès verrouillé", "ACCESS_LOCKED"),
    (r"en cours de traitement|en attente|locked by another", "ACCESS_LOCKED"),
    (r"preparation du rollback|transaction.*(rollback|annulée)|rollback", "TX_ROLLBACK"),
    (r"initiating transaction (rollback|commit)|abstractplatformtransaction", "TX_ROLLBACK"),
]
LOG_NOISE = (
    r"(?i)(preparation du retry suite|retry suite au deadlock|preparation du rollback|initiating transaction rollback|"
    r"rollback.*applied|abstractplatformtransactionmanager|no transactioninfo found.*thread|skipping commit|"
    r"no value for key.*bound to thread)"
)
TRACE_STOP_WORDS = ["le", "la", "les", "de", "du", "un", "une", "des", "est", "sur", "dans", "par", "en", "pour",
                    "avec", "que", "qui", "at", "in", "the", "an", "to", "of", "is", "for", "on", "com", "org", "java", "net"]

# file name -> parser, first match wins; names to skip
FILE_STRATEGIES = [
    (r"errors_sample", "app_error"), (r"exceptions_sample", "app_error"), (r"connector\w+_\d{8}", "app_error"),
    (r"\d{2}mapp_transaction", "transaction"), (r"solicitation\w+_\d{6}", "performance"), (r"nginx", "http"),
    (r"oracle|ORA", "database"),
]
SKIPPED_FILES = r"(?i)(app_tree|log_tree|PLACER_CSV|README|CHEATSHEET|tickets\.csv)"

# ---------------------------------------------------------------- document quality
ACTION_WORDS = [
    "vérifier", "supprimer", "modifier", "relancer", "exécuter", "connecter", "chercher", "identifier", "corriger",
    "mettre à jour", "contrôler", "lancer", "copier", "coller", "saisir", "sélectionner", "cliquer", "ouvrir",
    "fermer", "redémarrer", "recharger", "select", "delete", "update", "insert", "where", "from",
]
TECHNICAL_WORDS = [
    "erreur", "table", "base", "bdd", "sql", "vlan", "nd", "dslam", "carte", "port", "vc", "vp", "script", "requête",
    "commande", "procédure", "stockée", "trigger", "log", "trace", "exception",
]
VAGUE_PHRASES = ["ras", "ok", "corrigé", "résolu", "fait", "traité", "réglé", "n/a", "sans objet", "voir ci-dessus",
                 "cf.", "idem", "à compléter", "en cours", "tbd"]

# ---------------------------------------------------------------- trust of a knowledge document
SOURCE_TRUST = {
    "human_validated_fr": 1.00, "fr_unvalidated": 0.75, "jira_resolved": 0.70, "jira_open": 0.50, "cluster_large": 0.65,
    "cluster_medium": 0.50, "single_ticket": 0.30, "llm_generated": 0.20,
}
CRITICAL_INCIDENT_TYPES = ["backend_error.api_error", "system_integration_problem.interface_failure",
                           "network_equipment_issue.dslam_error"]

# ---------------------------------------------------------------- keyword -> (level 1, level 2, weight)
KEYWORD_SIGNALS = [
    ("script", "DATA", "DATA_CORRECTION_SCRIPT", 0.50), ("outil de correction", "DATA", "DATA_CORRECTION_SCRIPT", 0.55),
    ("correction script", "DATA", "DATA_CORRECTION_SCRIPT", 0.60), ("corrigé par script", "DATA", "DATA_CORRECTION_SCRIPT", 0.65),
    ("incohérence", "DATA", "DATA_INCONSISTENCY", 0.55), ("doublon", "DATA", "DATA_INCONSISTENCY", 0.55),
    ("incoherence", "DATA", "DATA_INCONSISTENCY", 0.55), ("doublons", "DATA", "DATA_INCONSISTENCY", 0.50),
    ("avp", "DATA", "DATA_INCONSISTENCY", 0.45), ("vlan", "DATA", "DATA_INCONSISTENCY", 0.40),
    ("blocage vlan", "DATA", "DATA_INCONSISTENCY", 0.55), ("vlan bloqué", "DATA", "DATA_INCONSISTENCY", 0.55),
    ("suppression", "DATA", "DATA_UPDATE_OR_DELETE", 0.40), ("supprimer", "DATA", "DATA_UPDATE_OR_DELETE", 0.40),
    ("suppression impossible", "DATA", "DATA_UPDATE_OR_DELETE", 0.55), ("mise à jour", "DATA", "DATA_UPDATE_OR_DELETE", 0.40),
    ("dossier stormshield", "DATA", "DATA_UPDATE_OR_DELETE", 0.50), ("données corrompues", "DATA", "DATA_CORRUPTION", 0.65),
    ("corruption", "DATA", "DATA_CORRUPTION", 0.65), ("configuration réseau", "DATA", "NETWORK_CONFIGURATION", 0.55),
    ("routeur", "DATA", "NETWORK_CONFIGURATION", 0.40), ("dslam", "DATA", "NETWORK_CONFIGURATION", 0.40),
    ("olt", "DATA", "NETWORK_CONFIGURATION", 0.40), ("nœud", "DATA", "NETWORK_CONFIGURATION", 0.35),
    ("ne/nb", "DATA", "NETWORK_CONFIGURATION", 0.45), ("bug", "APPLICATION", "APPLICATION_BUG", 0.55),
    ("erreur applicatif", "APPLICATION", "APPLICATION_BUG", 0.60), ("erreur 1300", "APPLICATION", "APPLICATION_BUG", 0.65),
    ("1300", "APPLICATION", "APPLICATION_BUG", 0.60), ("b4002", "APPLICATION", "APPLICATION_BUG", 0.60),
    ("ora-", "APPLICATION", "APPLICATION_BUG", 0.55), ("exception", "APPLICATION", "APPLICATION_BUG", 0.45),
    ("fonctionnalité", "APPLICATION", "APPLICATION_FUNCTIONALITY", 0.50), ("fonctionnement", "APPLICATION", "APPLICATION_FUNCTIONALITY", 0.45),
    ("droits", "ACCESS", "ACCESS_RIGHTS", 0.55), ("accès", "ACCESS", "ACCESS_RIGHTS", 0.50),
    ("habilitation", "ACCESS", "ACCESS_RIGHTS", 0.60), ("profil utilisateur", "ACCESS", "PERMISSION_CONFIGURATION", 0.55),
    ("non conformité profil", "ACCESS", "PERMISSION_CONFIGURATION", 0.65), ("connexion", "ACCESS", "LOGIN_ISSUE", 0.50),
    ("login", "ACCESS", "LOGIN_ISSUE", 0.50), ("mot de passe", "ACCESS", "LOGIN_ISSUE", 0.55),
    ("annulation", "OPERATIONS", "ANNULATION", 0.60), ("annulé", "OPERATIONS", "ANNULATION", 0.55),
    ("demande de travaux", "OPERATIONS", "SERVICE_REQUEST", 0.65), ("travaux", "OPERATIONS", "SERVICE_REQUEST", 0.45),
    ("prestation", "OPERATIONS", "SERVICE_REQUEST", 0.45), ("ordonnancement", "OPERATIONS", "SCHEDULING", 0.65),
    ("planification", "OPERATIONS", "SCHEDULING", 0.60), ("batch", "OPERATIONS", "SCHEDULING", 0.50),
    ("serveur indisponible", "PROCESS_ERROR", "SYSTEM_PROCESS_ERROR", 0.70), ("infrastructure", "PROCESS_ERROR", "SYSTEM_PROCESS_ERROR", 0.50),
    ("interface oracle", "PROCESS_ERROR", "SYSTEM_PROCESS_ERROR", 0.65), ("workflow", "PROCESS_ERROR", "WORKFLOW_ERROR", 0.60),
    ("processus bloqué", "PROCESS_ERROR", "WORKFLOW_ERROR", 0.65), ("traitement bloqué", "PROCESS_ERROR", "WORKFLOW_ERROR", 0.65),
    ("méconnaissance", "UNKNOWN", "UNDETERMINED", 0.50), ("cause inconnue", "UNKNOWN", "UNDETERMINED", 0.55),
]

# ---------------------------------------------------------------- text policy and answer markers
POLICY_RULES = [
    ("sql_mutation", r"(?im)(?:^|\s)(UPDATE|DELETE\s+FROM|INSERT\s+INTO|ALTER\s+TABLE|DROP\s+TABLE|TRUNCATE\s+TABLE)\b"),
    ("shell_cmd", r"(?im)(?:^|\s)(sudo\s|bash\s+|sh\s+|\.sh\b|systemctl\s|service\s+\w+\s+(?:start|stop|restart)|rm\s+-|chmod\s+|chown\s+)"),
    ("sql_placeholder", r"\[[A-Z][A-Z0-9_]{2,}\]"),
    ("hedge", r"(?i)je ne suis pas sûr\b|il me semble que\b|probablement\s+à\s+cause\s+de|cela\s+pourrait\s+être\s+dû|"
              r"il est possible que\b|peut[-\s]être que\b|dans la plupart des cas\b|i believe that\b|i think this might be\b"),
]
FILLER_LINES = [
    r"(?i)^\s*[-•]?\s*n['’]h[eé]sitez\s+pas\s+[àa]", r"(?i)^\s*[-•]?\s*je\s+reste\s+[àa]\s+votre\s+disposition",
    r"(?i)^\s*[-•]?\s*cordialement[,\s]", r"(?i)^\s*[-•]?\s*feel\s+free\s+to", r"(?i)^\s*[-•]?\s*let\s+me\s+know\s+if",
    r"(?i)^\s*[-•]?\s*hope\s+this\s+helps", r"(?i)^\s*[-•]?\s*probablement\b", r"(?i)^\s*[-•]?\s*en\s+g[eé]n[eé]ral\b",
]
OFF_TOPIC = [
    r"^(bonjour|bonsoir|salut|hello|hi|coucou|hey)\b", r"^(merci|au revoir|bye|bonne journée|bonne soirée)\b",
    r"^(comment ça va|ça va|comment allez|comment vas)", r"^(oui|non|ok|d'accord|vu|compris)\s*$",
]
PHASE_THRESHOLDS = {"diagnostic": 25.0, "investigation": 40.0, "resolution": 60.0, "closing": None}
CONSTRAINT_WORDS = (
    r"(?i)(obligatoire|mandatory|interdit|forbidden|impossible|cannot|must not|bloqué|ne peut pas|shall not|doit|must be|"
    r"error|erreur|exception|contrainte|constraint|validation)"
)
ENTITY_WORDS = (
    r"(?i)\b(DSLAM|MSAN|ONT|OLT|GPON|CARD|PORT|SHELF|NODE|NRA|NRO|EQUIPMENT|EPC|MRT|CCL|VLAN|MAKING.?FILE|OPERATOR|TSF|VP|VC)\b"
)
API_OPERATION = r"\b(GET|POST|PUT|DELETE|PATCH)\b"
API_PATH = r"(/[a-zA-Z0-9/_\-\{\}]{5,80})"
ANSWER_MARKERS = {
    "evidence": [r"(?i)SELECT\s+.+\s+FROM\s+t_\w+", r"(?i)colonnes?\s+:\s+\w+", r"(?i)FK\s+→\s+t_\w+|clé\s+étrangère\s+vers",
                 r"(?i)logs?\s*:\s*\[?\d{2}:\d{2}"],
    "red_flag": [r"(?i)je\s+suppose\s+que|I\s+suppose|I\s+assume|je\s+crois\s+que|j'imagine", r"(?i)t_unknown|t_temp|t_test|t_example|t_sample|t_dummy",
                 r"(?i)erreur\s+9999|code\s+9999|exception.*9999", r"(?i)statut\s+[GHIJKLMNQRUVWXYZ]\b",
                 r"(?i)based\s+on\s+(?:my\s+)?(?:training|knowledge\s+cutoff)"],
    "rca": [r"(?i)cause\s+(?:racine|root|principale)", r"(?i)chaine?\s+(?:de\s+)?causalit[eé]|causal\s+chain",
            r"(?i)(?:étape|step)\s+\d+\s*:\s*(?:vérifi|check)", r"(?i)résolution\s+en\s+\d+\s+étapes?"],
    "operational": [r"(?i)SELECT\s+.+\s+FROM\s+\w+\s+WHERE", r"(?i)étape\s+\d+|step\s+\d+|[1-9]\.\s+\w",
                    r"(?i)commande\s*:\s*.{5,}|command\s*:\s*.{5,}", r"(?i)(?:solution|fix|correction)\s*:\s*.{10,}",
                    r"(?i)procédure|procedure|runbook"],
}
ACCENTS_FROM, ACCENTS_TO = "éèêëàâäîïôöùûüç", "eeeeaaaiioouuuc"
