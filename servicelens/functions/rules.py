"""Rule data as plain Python values.

FIXED VALUES: everything in this module must equal the source application's
values for results to match (thresholds, weights, keyword lists, labels).  They are
listed plainly, in the order the application uses them, and turned into Spark
column expressions by ``servicelens.functions.columns`` / ``.text``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — SLA configuration
# ---------------------------------------------------------------------------

# priority -> (response minutes, resolution minutes)
SLA_THRESHOLDS = {
    1: (15.0, 240.0),
    2: (60.0, 480.0),
    3: (240.0, 1440.0),
    4: (480.0, 2880.0),
}
DEFAULT_PRIORITY = 3
TARGET_ADHERENCE = 0.95

# category -> (avg_resolution_time, breach_rate, escalation_rate); default 'hardware'
CATEGORY_STATS = {
    "hardware": (240.0, 0.15, 0.25),
    "software": (180.0, 0.12, 0.20),
    "infrastructure": (120.0, 0.08, 0.30),
    "access": (60.0, 0.05, 0.10),
}
DEFAULT_CATEGORY_STATS = "hardware"

# system load fallback (active tickets, utilisation, avg response time)
SYSTEM_LOAD_DEFAULT = (10.0, 0.7, 30.0)
SYSTEM_LOAD_FULL_AT = 20.0

# probability ladders, highest first; anything lower gets the default
BREACH_BUCKETS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]
BREACH_BUCKET_DEFAULT = "minimal"
SLA_STATUS = [(0.9, "BREACH_IMMINENT"), (0.7, "AT_RISK"), (0.5, "WATCH")]
SLA_STATUS_DEFAULT = "HEALTHY"

# time to breach: (min probability, floor minutes, share of remaining)
TIME_TO_BREACH = [(0.9, 5, 0.1), (0.7, 15, 0.3), (0.5, 30, 0.5)]

# heuristic model (remaining-minutes ladder)
HEURISTIC_RESPONSE = [(5.0, 0.9), (15.0, 0.7)]
HEURISTIC_RESOLUTION = (60.0, 0.6)
HEURISTIC_DEFAULT = 0.3
HEURISTIC_CONFIDENCE = 0.6

ACTION_THRESHOLD = 0.7
STATE_TTL_DAYS = 90

# ---------------------------------------------------------------------------
# FIXED VALUES — recommended action rules
# (min probability, category or None, max priority or None, lower-text word or None, action)
# in the order the application appends them
# ---------------------------------------------------------------------------

ACTIONS_BASE = [
    (0.9, None, None, None, "escalate-immediately"),
    (0.9, None, None, None, "notify-manager"),
    (0.9, "infrastructure", None, None, "trigger-incident-response"),
    (0.7, None, None, None, "boost-priority"),
    (0.7, None, None, None, "assign-senior-tech"),
    (0.7, "hardware", None, None, "dispatch-onsite-tech"),
    (0.7, "software", None, None, "engage-vendor-support"),
    (0.5, None, None, None, "send-reminder"),
    (0.5, None, None, None, "check-dependencies"),
    (0.5, None, 2, None, "prepare-workaround"),
    (0.6, "hardware", None, None, "check-spare-parts"),
    (0.4, "access", None, None, "auto-reset-password"),
]

ACTIONS_OPS = [
    (0.9, None, None, None, "escalate-immediately"),
    (0.9, None, None, None, "notify-manager"),
    (0.9, "infrastructure", None, None, "trigger-incident-response"),
    (0.7, None, None, None, "boost-priority"),
    (0.7, None, None, None, "assign-senior-tech"),
    (0.7, "hardware", None, None, "dispatch-onsite-tech"),
    (0.7, "infrastructure", None, None, "engage-vendor-support"),
    (0.5, None, None, None, "send-reminder"),
    (0.5, None, None, None, "check-dependencies"),
    (0.5, None, 2, None, "prepare-workaround"),
    (0.6, "hardware", None, None, "check-spare-parts"),
    (0.4, "access", None, None, "auto-reset-password"),
    (0.5, "network", None, None, "check-network-status"),
]

ACTIONS_CRITICAL = [
    (0.9, None, None, None, "escalate-immediately"),
    (0.9, None, None, None, "notify-manager"),
    (0.9, None, None, None, "trigger-incident-response"),
    (0.9, "infrastructure", None, None, "activate-war-room"),
    (0.9, "infrastructure", None, None, "notify-executives"),
    (0.9, None, None, "revenue", "notify-business-continuity-team"),
    (0.7, None, None, None, "boost-priority"),
    (0.7, None, None, None, "assign-senior-tech"),
    (0.7, None, None, None, "prepare-communication"),
    (0.7, "infrastructure", None, None, "check-backup-systems"),
    (0.7, "infrastructure", None, None, "prepare-failover"),
    (0.7, "security", None, None, "isolate-affected-systems"),
    (0.7, "security", None, None, "notify-security-team"),
    (0.7, "network", None, None, "check-redundancy"),
    (0.7, "network", None, None, "prepare-manual-failover"),
    (0.5, None, None, None, "send-urgent-reminder"),
    (0.5, None, None, None, "check-dependencies"),
    (0.5, None, None, None, "update-stakeholders"),
    (0.5, None, 2, None, "prepare-workaround"),
    (0.5, None, 2, None, "identify-alternatives"),
    (None, "infrastructure", None, None, "monitor-system-health"),
    (None, "infrastructure", None, None, "check-capacity"),
    (None, "security", None, None, "review-logs"),
    (None, "security", None, None, "check-compliance"),
    (None, "hardware", None, "executive", "expedite-replacement"),
    (None, "hardware", None, "executive", "arrange-temporary-solution"),
]

# actions that have a handler in the action trigger
KNOWN_ACTIONS = [
    "escalate-immediately", "notify-manager", "trigger-incident-response",
    "boost-priority", "assign-senior-tech", "dispatch-onsite-tech",
    "engage-vendor-support", "send-reminder", "check-spare-parts",
    "auto-reset-password", "schedule-followup",
]

# FIXED VALUES — action -> (channel, event type / workflow / topic, fields of its body; a pair renames a value)
ACTION_BODIES = {
    "escalate-immediately": ("workflow", "escalation", [
        "ticket_id", "escalation_reason", "breach_probability", "time_to_breach", "original_priority", "new_priority"]),
    "notify-manager": ("notification", "manager-alerts", [
        ("alert_subject", "subject"), "ticket_id", "category", "current_priority", "breach_percent", "time_to_breach",
        "recommended_actions"]),
    "trigger-incident-response": ("workflow", "incident-response", [
        "ticket_id", "incident_type", "category", "breach_probability", "time_to_breach", "severity", "triggered_by",
        "timestamp"]),
    "boost-priority": ("bus", "Priority Boost", [
        "ticket_id", "old_priority", "new_priority", "reason", "breach_probability", "updated_by", "timestamp"]),
    "assign-senior-tech": ("bus", "Senior Tech Assignment", [
        "ticket_id", "assignment_type", "reason", "breach_probability", "category", ("assignment_urgency", "urgency"),
        "timestamp"]),
    "dispatch-onsite-tech": ("bus", "Onsite Tech Dispatch", [
        "ticket_id", "dispatch_type", "category", "urgency", "breach_probability", "estimated_arrival", "timestamp"]),
    "engage-vendor-support": ("bus", "Vendor Support Engagement", [
        "ticket_id", "engagement_type", "category", "breach_probability", ("vendor_priority", "priority"), "timestamp"]),
    "send-reminder": ("notification", "technician-reminders", [
        ("reminder_subject", "subject"), "ticket_id", "category", "current_priority", "breach_percent", "time_to_breach"]),
    "check-spare-parts": ("bus", "Spare Parts Check", ["ticket_id", "check_type", "category", "urgency", "timestamp"]),
    "auto-reset-password": ("bus", "L1 Automation Trigger", [
        "ticket_id", "automation_type", "category", ("automation_by", "triggered_by"), "timestamp"]),
    "schedule-followup": ("bus", "Followup Scheduled", [
        "ticket_id", "followup_type", "original_breach_probability", "scheduled_at", "followup_time"]),
}

# FIXED VALUES — conditions of a licence change with medium-risk services
LICENSE_CONDITIONS = ["Stagger implementation across services", "Monitor affected services for 24 hours",
                      "Have rollback procedure ready"]

# scoring multipliers of the demo variants
CATEGORY_ADJUST_OPS = {"infrastructure": 1.2, "access": 0.8}
CRITICAL_WEIGHTS = {1: (0.9, 0.1), 2: (0.7, 0.3)}  # else (0.4, 0.6)
CRITICAL_WEIGHTS_DEFAULT = (0.4, 0.6)
CRITICAL_WORDS_CASED = ["URGENT", "CRITICAL"]  # x1.3, case-sensitive
CRITICAL_CATEGORY = {"infrastructure": 1.2, "security": 1.1}
CRITICAL_BUSINESS_WORDS = ["revenue", "business"]  # x1.15, lower-cased text

# ---------------------------------------------------------------------------
# FIXED VALUES — text-born tickets (priority P1..P4)
# ---------------------------------------------------------------------------

TEXT_SLA_HOURS = {"P1": 2, "P2": 8, "P3": 24, "P4": 72}
TEXT_BASE_PROBABILITY = {"P1": 0.85, "P2": 0.65, "P3": 0.45, "P4": 0.25}
TEXT_SERVICE_MULTIPLIER = {"aadhaar-auth": 1.3, "payment-gateway": 1.2, "citizen-portal": 1.1,
                           "mobile-app": 1.0, "certificate-services": 1.1, "other": 1.0}
TEXT_CITY_MULTIPLIER = 1.2
TEXT_HIGH_RISK_CITIES = ["Mumbai", "Delhi", "Bangalore", "Hyderabad", "Chennai", "Indore", "Bhopal"]
TEXT_PROBABILITY_CAP = 0.95
TEXT_BASE_REVENUE = {"P1": 200000, "P2": 100000, "P3": 50000, "P4": 20000}
EMAIL_REVENUE_MULTIPLIER = {"aadhaar-auth": 2.0, "payment-gateway": 1.8, "citizen-portal": 1.2,
                            "mobile-app": 1.1, "certificate-services": 1.3, "other": 1.0}
CUSTOMER_TIER = {"P1": "Enterprise", "P2": "Platinum", "P3": "Gold", "P4": "Silver"}
BUSINESS_IMPACT_BANDS = [(100000, "high"), (50000, "medium")]  # else low

# fallback risk variants
ADDITIVE_BASE_RISK = {"P1": 0.9, "P2": 0.6, "P3": 0.3, "P4": 0.1}
ADDITIVE_RESOLUTION_HOURS = {"P1": 4, "P2": 12, "P3": 24, "P4": 72}
TABLE_RISK = {"P1": 0.85, "P2": 0.65, "P3": 0.45, "P4": 0.25}
TABLE_RISK_HOURS = {"P1": 2, "P2": 8, "P3": 24, "P4": 72}

# 11-feature fallback predictor
PRIORITY_SCORE = {"P1": 4, "P2": 3, "P3": 2, "P4": 1}
PRIORITY_SCORE_DEFAULT = 2
DEPARTMENT_RISK = {"UIDAI": 0.8, "MeiTY": 0.6, "DigitalMP": 0.4, "Other": 0.3}
DEPARTMENT_RISK_DEFAULT = 0.3

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword rule sets (lower-cased substrings; first match wins
# unless the rule set is scored).  Order is the application's order.
# ---------------------------------------------------------------------------

DEPARTMENT_NLAPI = [
    ("UIDAI", ["aadhaar", "authentication", "biometric", "uid"]),
    ("MeiTY", ["payment", "gateway", "transaction", "money"]),
    ("DigitalMP", ["portal", "website", "digital", "online"]),
    ("eDistrict", ["certificate", "document", "app"]),
]
DEPARTMENT_NLAPI_CONFIDENCE = {"UIDAI": 0.95, "MeiTY": 0.90, "DigitalMP": 0.88, "eDistrict": 0.85}
DEPARTMENT_NLAPI_DEFAULT = ("MPOnline", 0.6)

DEPARTMENT_EMAIL = [
    ("UIDAI", ["aadhaar", "aadhar", "authentication", "biometric"]),
    ("MeiTY", ["payment", "transaction", "money", "bank"]),
    ("DigitalMP", ["portal", "website", "digital", "online"]),
    ("eDistrict", ["certificate", "document", "service"]),
]
DEPARTMENT_SHORT = [
    ("UIDAI", ["aadhaar", "authentication", "biometric"]),
    ("MeiTY", ["payment", "gateway", "transaction"]),
    ("DigitalMP", ["portal", "website", "digital"]),
    ("eDistrict", ["certificate", "document"]),
]
DEPARTMENT_GENAI = [
    ("UIDAI", ["aadhaar", "uid", "authentication"]),
    ("MeiTY", ["payment", "gateway", "transaction"]),
    ("DigitalMP", ["portal", "website", "login"]),
]
DEPARTMENT_DEFAULT = "MPOnline"

# scored (argmax of distinct keyword hits, ties to first listed)
DEPARTMENT_SCORED_CORE = [
    ("UIDAI", ["aadhaar", "uid", "authentication", "biometric", "identity", "verification"]),
    ("MeitY", ["payment", "gateway", "transaction", "money", "billing", "financial"]),
    ("DigitalMP", ["portal", "website", "digital", "online", "platform", "interface"]),
    ("eDistrict", ["certificate", "document", "verification", "attestation", "record"]),
]
DEPARTMENT_SCORED_CHAT = [
    ("UIDAI", ["aadhaar", "aadhar", "authentication", "biometric", "uid", "identity"]),
    ("MeiTY", ["payment", "transaction", "gateway", "money", "bank", "financial"]),
    ("DigitalMP", ["portal", "website", "digital", "online", "web", "platform"]),
    ("eDistrict", ["certificate", "document", "service", "district", "govt"]),
    ("MPOnline", ["general", "other", "misc", "support"]),
]

PRIORITY_CORE = [
    ("P1", ["critical", "urgent", "emergency", "down", "failed", "completely", "thousands", "outage"]),
    ("P2", ["important", "high", "serious", "significant", "timeout", "intermittent", "affecting"]),
    ("P4", ["minor", "low", "small", "question", "inquiry", "thank", "good", "excellent"]),
]
PRIORITY_CHAT = [
    ("P1", ["critical", "urgent", "emergency", "down", "failing", "outage", "broken", "crashed"]),
    ("P2", ["important", "high", "serious", "asap", "priority", "significant"]),
    ("P3", ["issue", "problem", "help", "support", "assistance", "trouble"]),
    ("P4", ["question", "inquiry", "minor", "small", "clarification"]),
]
PRIORITY_NLAPI = [
    ("P1", ["critical", "urgent", "failing", "down", "emergency"]),
    ("P2", ["important", "high", "serious", "asap"]),
    ("P4", ["minor", "small", "question"]),
]
PRIORITY_EMAIL = [
    ("P1", ["critical", "urgent", "emergency", "outage", "down"]),
    ("P2", ["important", "asap", "priority", "high"]),
    ("P3", ["issue", "problem", "help"]),
]
PRIORITY_EMAIL_DEFAULT = "P4"
PRIORITY_DEFAULT = "P3"

CATEGORY_CORE = [
    ("Authentication", ["login", "password", "authentication", "aadhaar", "biometric"]),
    ("Payment", ["payment", "transaction", "gateway", "money", "billing"]),
    ("Portal", ["portal", "website", "interface", "page", "digital"]),
    ("Network", ["network", "connection", "timeout", "slow", "connectivity"]),
    ("Certificate", ["certificate", "document", "verification", "attestation"]),
]
CATEGORY_DEFAULT = "Other"

PRIORITY_REASON_ANALYSIS = {"P1": "Critical/Urgent keywords detected", "P2": "High importance indicators",
                            "P4": "Low priority indicators"}
PRIORITY_REASON_ANALYSIS_DEFAULT = "Standard issue"

# ---------------------------------------------------------------------------
# FIXED VALUES — the classifiers of the other intakes: for each field the rules in order (first match wins)
# and what stands where none matches
# ---------------------------------------------------------------------------
_SERVICE_FIVE = [
    ("aadhaar-auth", ["aadhaar", "authentication"]),
    ("payment-gateway", ["payment", "gateway"]),
    ("citizen-portal", ["portal", "website"]),
    ("mobile-app", ["mobile", "app"]),
    ("certificate-services", ["certificate", "document"]),
]
INTAKE_CLASSIFIERS = {
    "live_email": {
        "priority": ([("P1", ["critical", "urgent", "emergency", "outage", "down", "failing"]),
                      ("P2", ["important", "asap", "priority", "high", "serious"]),
                      ("P4", ["question", "inquiry", "request", "minor"])], "P3"),
        "department": ([("UIDAI", ["aadhaar", "aadhar", "authentication", "biometric", "uid"]),
                        ("MeiTY", ["payment", "transaction", "money", "bank", "gateway"]),
                        ("DigitalMP", ["portal", "website", "digital", "online"]),
                        ("eDistrict", ["certificate", "document", "service", "district"])], "MPOnline"),
        "service_type": ([("aadhaar-auth", ["aadhaar", "authentication", "biometric"]),
                          ("payment-gateway", ["payment", "gateway", "transaction"]),
                          ("citizen-portal", ["portal", "website"]),
                          ("mobile-app", ["mobile", "app", "smartphone"]),
                          ("certificate-services", ["certificate", "document"])], "other"),
    },
    "plain_email": {
        "priority": ([("critical", ["critical", "urgent", "emergency", "outage", "down"]),
                      ("high", ["important", "asap", "priority", "escalate"]),
                      ("medium", ["issue", "problem", "help"]),
                      ("low", ["question", "inquiry", "request"])], "medium"),
        "department": ([], None),
        "service_type": ([("aadhaar", ["aadhaar", "aadhar", "authentication", "biometric", "otp"]),
                          ("payment", ["payment", "transaction", "money", "bank", "upi", "wallet"]),
                          ("portal", ["portal", "website", "login", "access", "account"]),
                          ("mobile", ["mobile", "app", "smartphone", "android", "ios"]),
                          ("network", ["network", "internet", "connection", "wifi", "data"])], "general"),
    },
    "simple_reader": {
        "priority": ([("P1", ["critical", "urgent", "emergency", "outage", "down"]),
                      ("P2", ["important", "asap", "priority", "high"]),
                      ("P4", ["question", "inquiry", "request"])], "P3"),
        "department": (DEPARTMENT_EMAIL, "MPOnline"),
        "service_type": (_SERVICE_FIVE, "other"),
    },
    "chatbot": {
        "priority": ([("P1", ["critical", "urgent", "emergency", "down", "failing", "outage"]),
                      ("P2", ["important", "high", "serious", "asap"]),
                      ("P4", ["question", "minor", "small"])], "P3"),
        "department": ([("UIDAI", ["aadhaar", "aadhar", "authentication", "biometric", "uid"]),
                        ("MeiTY", ["payment", "transaction", "money", "bank", "gateway"]),
                        ("DigitalMP", ["portal", "website", "digital", "online"]),
                        ("eDistrict", ["certificate", "document", "service"])], "MPOnline"),
        "service_type": (_SERVICE_FIVE, "other"),
    },
    "simple_chatbot": {
        "priority": ([("P1", ["critical", "urgent", "failing"])], "P3"),
        "department": ([("UIDAI", ["aadhaar"]), ("MeiTY", ["payment"])], "DigitalMP"),
        "service_type": ([], None),
    },
    "genai": {
        "priority": ([("P1", ["critical", "urgent", "down", "failed"]), ("P2", ["important", "high", "issue"])], "P3"),
        "department": (DEPARTMENT_GENAI, "Other"),
        "service_type": ([], None),
    },
    "genai_ui": {
        "priority": ([("P1", ["critical", "urgent", "down"]), ("P2", ["issue", "problem"])], "P3"),
        "department": ([("UIDAI", ["aadhaar", "authentication"]), ("MeiTY", ["payment", "gateway"]),
                        ("DigitalMP", ["portal", "website"])], "Other"),
        "service_type": ([], None),
    },
    "cloud": {
        "priority": ([("P1", ["critical", "urgent", "failing", "down"]), ("P2", ["important", "high", "serious"]),
                      ("P4", ["minor", "small", "question"])], "P3"),
        "department": (DEPARTMENT_SHORT, "MPOnline"),
        "service_type": ([], None),
    },
}

# FIXED VALUES — tickets of four of these intakes: base probability and revenue by priority, multipliers by service, hours to
# the deadline, customer tier by priority, confidence, status; departments by service where the classifier names none
MAJOR_CITIES = ["mumbai", "delhi", "bangalore", "hyderabad", "chennai"]
_BY_P = {"probability": {"P1": 0.85, "P2": 0.65, "P3": 0.45, "P4": 0.25}, "revenue": {"P1": 200000, "P2": 100000, "P3": 50000, "P4": 20000},
         "hours": {"P1": 2, "P2": 8, "P3": 24, "P4": 72},
         "tier": {"P1": "Enterprise", "P2": "Platinum", "P3": "Gold", "P4": "Silver"}, "status": "Open", "city": 1.0}
_SERVICE_RISK = {"aadhaar-auth": 1.3, "payment-gateway": 1.2, "citizen-portal": 1.1, "mobile-app": 1.0, "certificate-services": 1.1, "other": 1.0}
INTAKE_TICKETS = {
    "chatbot": _BY_P | {"source": "chatbot", "confidence": 0.90, "service_probability": _SERVICE_RISK, "service_revenue": _SERVICE_RISK},
    "live_email": _BY_P | {"source": "email", "confidence": 0.85, "service_probability": _SERVICE_RISK,
                           "service_revenue": {"aadhaar-auth": 2.0, "payment-gateway": 1.8, "citizen-portal": 1.2, "mobile-app": 1.1,
                                               "certificate-services": 1.3, "other": 1.0}},
    "simple_reader": _BY_P | {"source": "email", "confidence": 0.85, "service_probability": {}, "service_revenue": {}},
    "plain_email": {
        "source": "email", "confidence": None, "status": "new", "city": 1.2,
        "probability": {"critical": 0.8, "high": 0.6, "medium": 0.4, "low": 0.2},
        "revenue": {"critical": 200000, "high": 100000, "medium": 50000, "low": 10000},
        "hours": {"critical": 2, "high": 8, "medium": 24, "low": 72},
        "tier": {"critical": "Enterprise", "high": "Platinum", "medium": "Gold", "low": "Silver"},
        "service_probability": {"aadhaar": 1.3, "payment": 1.2, "portal": 1.1, "mobile": 1.0, "network": 1.1, "general": 1.0},
        "service_revenue": {"aadhaar": 2.0, "payment": 1.8, "portal": 1.2, "mobile": 1.1, "network": 1.3, "general": 1.0},
        "department": {"aadhaar": "Identity Services", "payment": "Financial Services", "portal": "IT Support", "mobile": "Mobile Support",
                       "network": "Infrastructure", "general": "General Support"}},
}

RESPONSE_TEMPLATES = {
    "P1": "Thank you for reporting this critical issue. We have escalated this to our emergency response team "
          "and will provide updates every hour.",
    "P2": "Thank you for your report. This has been assigned high priority and our technical team is "
          "investigating. We'll update you within 4 hours.",
    "P3": "Thank you for contacting us. Your ticket has been received and assigned to our support team. "
          "We'll respond within 24 hours.",
    "P4": "Thank you for your inquiry. We've received your request and will respond within 72 hours.",
}
RESPONSE_HOURS = {"P1": 4, "P2": 12, "P3": 24, "P4": 72}

FLOW_STEPS = ["dynamodb_stored", "eventbridge_triggered", "sagemaker_analyzed", "stepfunctions_started",
              "alerts_sent", "quicksight_updated", "s3_archived", "retraining_triggered"]

SERVICE_CHAT = [
    ("aadhaar-auth", ["aadhaar", "authentication", "biometric", "verification"]),
    ("payment-gateway", ["payment", "gateway", "transaction", "money"]),
    ("citizen-portal", ["portal", "website", "login", "access"]),
    ("mobile-app", ["mobile", "app", "smartphone", "application"]),
    ("certificate-services", ["certificate", "document", "download"]),
]
SERVICE_SHORT = [
    ("aadhaar-auth", ["aadhaar", "authentication"]),
    ("payment-gateway", ["payment", "gateway"]),
    ("citizen-portal", ["portal", "website"]),
    ("mobile-app", ["mobile", "app"]),
    ("certificate-services", ["certificate", "document"]),
]
SERVICE_DEFAULT = "other"

URGENCY_WORDS = [
    ("critical", 9), ("urgent", 8), ("emergency", 9), ("immediately", 8),
    ("thousands", 7), ("hundreds", 6), ("many", 5), ("several", 4),
    ("completely", 8), ("totally", 7), ("partially", 4), ("sometimes", 3),
    ("revenue", 6), ("business", 5), ("citizens", 6), ("public", 5),
]
URGENCY_BASE = 5
URGENCY_MAX = 10

SENTIMENT_NEGATIVE = ["angry", "frustrated", "disappointed", "terrible", "awful", "horrible"]
SENTIMENT_NEGATIVE_NLAPI = ["angry", "frustrated", "terrible", "awful", "horrible"]
SENTIMENT_POSITIVE = ["please", "help", "thank", "appreciate", "grateful"]
URGENCY_LEVEL_WORDS = ["urgent", "asap", "immediately", "now", "quickly"]

SUPPORT_KEYWORDS_BASE = [
    "problem", "issue", "error", "fail", "not working", "down", "outage",
    "authentication", "aadhaar", "service", "unable", "cannot", "help", "support",
    "urgent", "critical", "broken", "bug", "complaint",
]
SUPPORT_KEYWORDS_EMAIL = [
    "problem", "issue", "error", "fail", "not working", "down", "outage",
    "authentication", "aadhaar", "service", "unable", "cannot", "help", "support",
    "urgent", "critical", "broken", "bug", "complaint",
    "payment", "portal", "mobile", "app", "certificate", "digital",
]
SUPPORT_KEYWORDS_LIVE = [
    "problem", "issue", "error", "fail", "not working", "down", "outage",
    "authentication", "aadhaar", "service", "unable", "cannot", "help",
    "support", "urgent", "critical", "broken", "bug", "complaint",
    "payment", "portal", "mobile", "app", "certificate", "digital",
    "timeout", "slow", "crash", "login", "access",
]

AFFECTED_USERS_WORDS = ["many", "multiple", "all"]

GAZETTEER = [
    "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "pune",
    "ahmedabad", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "bhopal",
    "visakhapatnam", "patna", "vadodara", "gwalior", "jabalpur", "ujjain", "sagar",
    "dewas", "satna", "ratlam", "maharashtra", "karnataka", "tamil nadu",
    "uttar pradesh", "gujarat", "rajasthan", "west bengal", "madhya pradesh",
    "telangana", "bihar",
]
LOCATION_NONE = "Not specified"
# first-hit list of the natural-language API
LOCATIONS_NLAPI = [
    "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "pune",
    "ahmedabad", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "bhopal",
    "visakhapatnam", "patna", "vadodara", "gwalior",
]
# all-hits list of the e-mail path
LOCATIONS_EMAIL = [
    "mumbai", "delhi", "bangalore", "hyderabad", "chennai", "kolkata", "pune",
    "ahmedabad", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "bhopal",
    "visakhapatnam", "patna", "vadodara", "maharashtra", "karnataka", "tamil nadu",
    "uttar pradesh", "gujarat", "rajasthan", "west bengal", "madhya pradesh",
    "telangana", "bihar",
]

# multi-select cleaning orders
CATEGORY_ORDER = ["Authentication", "Payment", "Portal", "Certificate", "Network", "Integration", "Other"]
SCOPE_ORDER = ["critical_infrastructure", "statewide", "regional", "department", "single_user"]
PRIORITY_ORDER = ["P1", "P2", "P3", "P4"]

# ---------------------------------------------------------------------------
# FIXED VALUES — change gating
# ---------------------------------------------------------------------------

OPTIMIZATION_IMPACT_DELTA = {"low": 0.02, "medium": 0.05, "high": 0.1, "critical": 0.2}
OPTIMIZATION_IMPACT_DEFAULT = 0.02
ASSET_DEFAULT_STATUS = (0.3, 0, 1, 1, "healthy")  # avg p, at risk, healthy, total, status
SERVICE_DEFAULT_STATE = (0.2, "HEALTHY", 60.0, 240.0)
CONDITIONAL_SAVINGS_MIN = 100000.0

# ---------------------------------------------------------------------------
# FIXED VALUES — licences and procurement
# ---------------------------------------------------------------------------

UNDERUTILIZED_BELOW = 0.7
REDUCTION_BUFFER = 1.2
RENEWAL_WINDOW_DAYS = 90
RENEWAL_OPPORTUNITY = 0.15
COMMUNICATION_TOOLS = ["zoom", "teams", "slack", "meet", "webex"]
CONSOLIDATION_SAVING = 0.4
DUPLICATE_VENDOR_SAVING = 0.3
HIGH_PRIORITY_SAVINGS = 100000.0
RECOMMENDATION_CONFIDENCE = {"LICENSE_REDUCTION": 0.85, "CONSOLIDATION": 0.75, "RENEWAL_OPTIMIZATION": 0.70}
IMPLEMENTATION_MULTIPLIER = {"LICENSE_REDUCTION": 1.0, "CONSOLIDATION": 2.0, "RENEWAL_OPTIMIZATION": 0.5}
IMPLEMENTATION_SHARE = 0.05
APPROVAL_LEVELS = [
    (5000000.0, "LEVEL_4_CEO"),
    (2000000.0, "LEVEL_3_CTO"),
    (500000.0, "LEVEL_2_FINANCE_DIRECTOR"),
]
APPROVAL_LEVEL_DEFAULT = "LEVEL_1_DEPARTMENT_HEAD"
APPROVERS = [
    "dept_head@organization.gov.in", "finance_director@organization.gov.in",
    "cto@organization.gov.in", "ceo@organization.gov.in",
]
QUOTE_TECHNICAL_WEIGHT = 0.7
QUOTE_COMMERCIAL_WEIGHT = 0.3
QUOTE_ACCEPT_AT = 70.0
QUOTE_COMPLIANT_AT = 60.0
MARKET_PRICE_FACTOR = 1.2
BID_DEADLINE_DAYS = 15
