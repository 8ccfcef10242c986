"""Fixed values of the email domain: word lists, patterns, labels and templates.

Everything in this module is data.  The values decide the results (a score, a
label, a reply text), so they have to be exactly these; the code that applies
them lives in the sibling modules.
"""

# ---------------------------------------------------------------------------
# Category dimension (name, slug, icon, colour); last = default
# ---------------------------------------------------------------------------
CATEGORIES = [
    ("Job / Career", "job_career", "Briefcase", "#6366F1"),
    ("Work / Professional", "work_professional", "Building2", "#8B5CF6"),
    ("Education", "education", "GraduationCap", "#3B82F6"),
    ("E-commerce / Shopping", "ecommerce_shopping", "ShoppingBag", "#F59E0B"),
    ("Finance / Banking", "finance_banking", "CreditCard", "#EF4444"),
    ("Travel", "travel", "Plane", "#06B6D4"),
    ("Healthcare", "healthcare", "HeartPulse", "#EC4899"),
    ("Social / Personal", "social_personal", "Users", "#10B981"),
    ("Events / Invitations", "events_invitations", "CalendarDays", "#F97316"),
    ("Government / Official", "government_official", "Landmark", "#64748B"),
    ("Promotions / Marketing", "promotions_marketing", "Tag", "#A855F7"),
    ("Notifications", "notifications", "Bell", "#0EA5E9"),
    ("Customer Support", "customer_support", "Headphones", "#14B8A6"),
    ("Other", "other", "Mail", "#94A3B8"),
]
DEFAULT_CATEGORY = ("Other", "other")

REVIEW_BELOW = 0.55      # a less certain prediction goes to a human
TRUST_MODEL_FROM = 0.70  # a more certain model is only overruled by strong phrases

# ---------------------------------------------------------------------------
# Keywords per category, in tie-break order
# ---------------------------------------------------------------------------
CATEGORY_KEYWORDS = {
    "Job / Career": ["interview", "job offer", "hiring", "vacancy", "resume", "cv", "application",
                     "career", "recruitment", "position", "candidate"],
    "Work / Professional": ["meeting", "project", "deadline", "team", "colleague", "office", "manager",
                            "sprint", "deliverable", "client", "proposal"],
    "Education": ["assignment", "exam", "course", "semester", "professor", "university", "college",
                  "grade", "lecture", "homework", "syllabus"],
    "E-commerce / Shopping": ["order", "shipment", "delivery", "product", "amazon", "flipkart", "cart",
                              "purchase", "tracking", "dispatch", "refund"],
    "Finance / Banking": ["bank", "account", "transaction", "payment", "credit card", "debit", "loan",
                          "emi", "upi", "neft", "suspicious", "fraud"],
    "Travel": ["flight", "hotel", "booking", "travel", "itinerary", "boarding", "reservation", "trip",
               "airline", "check-in"],
    "Healthcare": ["appointment", "doctor", "hospital", "prescription", "clinic", "medical", "health",
                   "diagnosis", "test result"],
    "Social / Personal": ["invitation", "wedding", "birthday", "party", "celebrate", "friend", "family",
                          "dinner", "catch up"],
    "Events / Invitations": ["event", "conference", "webinar", "seminar", "workshop", "register", "attend",
                             "venue", "speaker"],
    "Government / Official": ["government", "tax", "official", "authority", "notice", "legal", "compliance",
                              "regulatory", "aadhaar", "pan"],
    "Promotions / Marketing": ["offer", "discount", "sale", "promo", "coupon", "deal", "% off",
                               "limited time", "exclusive", "subscribe"],
    "Notifications": ["notification", "alert", "reminder", "update", "system", "automated", "do not reply"],
    "Customer Support": ["support", "ticket", "complaint", "issue", "help", "resolve", "customer service",
                         "query", "request"],
}

# ---------------------------------------------------------------------------
# Phrase hints (pattern, words added for the model, category)
# ---------------------------------------------------------------------------
CATEGORY_HINTS = [
    (r"\b(leave|time off|days off|vacation request|work from home|remote work|manager|project|meeting)\b",
     "work professional", "Work / Professional"),
    (r"\b(interview|resume|recruiter|job offer|hiring)\b", "job career", "Job / Career"),
    (r"\b(bank|payment|transaction|credit card|debit card|account balance|fraud|otp)\b",
     "finance banking bank payment transaction credit card debit account", "Finance / Banking"),
    (r"\b(flight|hotel|booking|boarding pass|itinerary)\b", "travel", "Travel"),
    (r"\b(exam|course|university|college|semester|assignment)\b", "education", "Education"),
    (r"\b(support ticket|technical issue|customer complaint|service complaint)\b",
     "customer support", "Customer Support"),
]
STRONG_PHRASES = {
    "Work / Professional": r"\b(days off|vacation request|work from home|remote work|project|meeting)\b",
    "Job / Career": r"\b(interview|resume|recruiter|job offer|hiring)\b",
    "Finance / Banking": r"\b(bank|payment|transaction|credit card|debit card|account balance|fraud|otp)\b",
    "Travel": r"\b(flight|hotel|booking|boarding pass|itinerary)\b",
    "Education": r"\b(exam|course|university|college|semester|assignment)\b",
    "Customer Support": r"\b(support ticket|technical issue|customer complaint|service complaint)\b",
}

# ---------------------------------------------------------------------------
# Labels of the public corpus -> our category names
# ---------------------------------------------------------------------------
PUBLIC_LABELS = {
    "Business": "Work / Professional",
    "Customer Support": "Customer Support",
    "Events & Invitations": "Events / Invitations",
    "Finance & Bills": "Finance / Banking",
    "Job Application": "Job / Career",
    "Newsletters": "Promotions / Marketing",
    "Personal": "Social / Personal",
    "Promotions": "Promotions / Marketing",
    "Reminders": "Notifications",
    "Travel & Bookings": "Travel",
}

# ---------------------------------------------------------------------------
# Intents as (pattern, label, priority); the highest priority
# wins, listing order breaks ties
# ---------------------------------------------------------------------------
INTENTS = [
    # jobs
    (r"interview.*scheduled|schedule.*interview|invite.*interview|interview.*invitation", "Interview Invitation", 100),
    (r"job offer|pleased to offer|offer of employment|formal offer", "Job Offer", 100),
    (r"we regret|unfortunately.*not|not been selected|unsuccessful", "Job Rejection", 90),
    (r"application.*received|thank you for applying|applied for", "Application Confirmation", 80),
    (r"reference check|background check", "Reference Check", 80),
    (r"salary|compensation|package|ctc|benefits", "Salary Discussion", 70),
    # education
    (r"assignment.*due|submission.*deadline|deadline.*assignment|project.*due", "Assignment Deadline", 100),
    (r"exam.*schedule|examination.*date|test.*date", "Exam Notification", 100),
    (r"admission.*confirm|confirmed.*admission|seat.*confirm", "Admission Confirmation", 100),
    (r"grade|result.*publish|marks.*available|scorecard", "Result Notification", 90),
    (r"fee.*due|tuition.*payment|fee.*reminder", "Fee Payment Reminder", 90),
    (r"class.*cancel|lecture.*cancel|session.*postpone", "Class Cancellation", 85),
    (r"scholarship|financial aid", "Scholarship Information", 80),
    # shopping
    (r"order.*confirm|confirm.*order|order.*placed", "Order Confirmation", 100),
    (r"order.*ship|shipped|out for delivery|delivery.*schedule", "Shipping Update", 90),
    (r"order.*deliver|delivered.*successfully", "Delivery Confirmation", 90),
    (r"refund.*process|refund.*initiat|money.*back|return.*approv", "Refund Update", 90),
    (r"return.*request|request.*return|return.*initiat", "Return Request", 85),
    (r"order.*cancel|cancel.*order", "Order Cancellation", 85),
    (r"invoice|receipt|payment.*confirm", "Invoice/Receipt", 80),
    # banking
    (r"suspicious.*activity|unauthorized.*access|fraud.*alert|security.*alert", "Security Alert", 100),
    (r"otp|one.time.*password|verification.*code", "OTP/Verification", 100),
    (r"account.*block|card.*block|suspend", "Account Blocked", 100),
    (r"transaction.*alert|debit.*alert|credit.*alert|amount.*debit|amount.*credit", "Transaction Alert", 90),
    (r"statement.*available|account.*statement", "Account Statement", 70),
    (r"loan.*approv|loan.*rejected", "Loan Update", 85),
    (r"payment.*due|emi.*due|bill.*due", "Payment Due", 90),
    # travel
    (r"flight.*confirm|booking.*confirm|e.ticket|boarding.*pass", "Flight Confirmation", 100),
    (r"flight.*cancel|cancellation.*flight", "Flight Cancellation", 95),
    (r"flight.*delay|delayed.*flight", "Flight Delay", 90),
    (r"hotel.*confirm|reservation.*confirm", "Hotel Confirmation", 90),
    (r"check.in.*reminder|check.in.*available", "Check-in Reminder", 85),
    # health
    (r"appointment.*confirm|confirm.*appointment|appointment.*schedul", "Appointment Confirmation", 100),
    (r"appointment.*remind|reminder.*appointment", "Appointment Reminder", 95),
    (r"appointment.*cancel|cancel.*appointment", "Appointment Cancellation", 90),
    (r"test.*result|lab.*result|report.*available", "Test Results", 90),
    (r"prescription.*ready|medication.*ready", "Prescription Ready", 85),
    # work
    (r"meeting.*schedul|schedule.*meeting|invite.*meeting|meeting.*invitation", "Meeting Invitation", 95),
    (r"meeting.*cancel|cancel.*meeting", "Meeting Cancellation", 90),
    (r"meeting.*reschedul|reschedule.*meeting", "Meeting Rescheduled", 90),
    (r"project.*update|status.*update|progress.*report", "Project Update", 75),
    (r"performance.*review|appraisal", "Performance Review", 85),
    (r"deadline.*project|project.*deadline", "Project Deadline", 90),
    # support
    (r"ticket.*open|case.*open|support.*request.*creat", "Support Ticket Created", 80),
    (r"ticket.*resolv|case.*resolv|issue.*resolv", "Issue Resolved", 75),
    (r"follow.*up|following up", "Follow-up", 70),
    (r"complaint.*receiv|complaint.*log", "Complaint Received", 80),
    # events
    (r"invite.*event|invitation.*event|event.*invite", "Event Invitation", 90),
    (r"webinar.*register|register.*webinar|webinar.*confirm", "Webinar Registration", 85),
    (r"conference.*register|seminar.*register", "Conference Registration", 85),
    # authorities
    (r"tax.*notice|income.*tax|it.*return", "Tax Notice", 95),
    (r"pan.*card|aadhaar|passport.*renew", "Document Update", 85),
    (r"legal.*notice|court.*notice", "Legal Notice", 100),
    # marketing
    (r"offer.*expires|sale.*end|last.*chance|limited.*time", "Expiring Offer", 75),
    (r"exclusive.*offer|special.*deal|coupon.*code|promo.*code", "Promotional Offer", 60),
    (r"newsletter|weekly.*digest|monthly.*digest", "Newsletter", 40),
    # social
    (r"birthday|happy birthday", "Birthday Greeting", 50),
    (r"wedding.*invitation|invite.*wedding", "Wedding Invitation", 80),
    (r"catch.*up|let.*meet|coffee|lunch|dinner.*plan", "Social Meetup", 60),
]
INTENT_BY_CATEGORY = {
    "job_career": "Career Communication",
    "education": "Academic Notification",
    "ecommerce_shopping": "Order/Shopping Update",
    "finance_banking": "Financial Notification",
    "travel": "Travel Update",
    "healthcare": "Medical Communication",
    "work_professional": "Work Communication",
    "events_invitations": "Event Information",
    "government_official": "Official Communication",
    "promotions_marketing": "Promotional Content",
    "notifications": "System Notification",
    "customer_support": "Support Communication",
    "social_personal": "Personal Message",
}
DEFAULT_INTENT = "General Information"

# ---------------------------------------------------------------------------
# Priority signals.  Patterns are matched on lower-cased text.
# ---------------------------------------------------------------------------
URGENCY_WORDS = [
    "urgent", "urgently", "immediately", "asap", "as soon as possible",
    "right away", "without delay", "critical", "emergency", "time-sensitive",
    "time sensitive", "prompt", "promptly", "deadline", "expires",
]
URGENCY_POINTS_EACH, URGENCY_POINTS_MAX = 5, 15

# text tiers, most pressing first: (patterns, points, reason)
DEADLINE_TIERS = [
    ([r"\btoday\b", r"\bby end of day\b", r"\bby eod\b", r"\bby close of business\b", r"\bbefore midnight\b"],
     25, "Deadline is today — extremely time-sensitive"),
    ([r"\btomorrow\b", r"\bwithin 24 hours\b", r"\bby tomorrow\b"],
     22, "Deadline occurs within 24 hours"),
    ([r"\bday after tomorrow\b", r"\bwithin 48 hours\b", r"\bin 2 days\b"],
     15, "Deadline within 48 hours"),
    ([r"\bthis week\b", r"\bwithin a week\b", r"\bby (monday|tuesday|wednesday|thursday|friday)\b"],
     8, "Deadline within the current week"),
    ([r"\bby\s+\w+\s+\d{1,2}", r"\bdue\s+(on|by|before)\b"],
     5, "Specific deadline date mentioned"),
]
# dated tiers: (at most this many hours ahead, points, reason); None = any later time
DEADLINE_HOURS = [
    (24, 25, "Deadline is within 24 hours"),
    (48, 22, "Deadline is within 48 hours"),
    (168, 8, "Deadline is within the current week"),
    (None, 5, "Future deadline detected"),
]
DEADLINE_MENTIONED = "Deadline detected: "
URGENCY_REASON = "Urgency language detected: "

ACTION_PATTERNS = [
    r"\bplease (confirm|reply|respond|call|contact|approve|submit|fill|complete|provide|send)\b",
    r"\brequires? (your|a) (response|reply|confirmation|approval|action|attention)\b",
    r"\baction required\b",
    r"\brespond by\b",
    r"\bplease (let us|let me) know\b",
    r"\byour (confirmation|response|reply|approval) is (required|needed|requested)\b",
    r"\bkindly (confirm|reply|respond|submit)\b",
    r"\b(?:request|requesting|requested)\s+(?:for\s+)?(?:a\s+)?(?:sick\s+)?leave\b",
    r"\b(?:grant|approve)\s+(?:(?:me|my)\s+)?(?:the\s+)?(?:sick\s+)?leave\b",
    r"\bwaiting for your (response|reply|confirmation)\b",
    r"\bverify (your|the) (identity|account|details)\b",
    r"\bplease (verify|validate|confirm)\b",
    r"\bimmediately\b",
]
ACTION_POINTS = 15
ACTION_REASON_DETECTED = "Explicit action or confirmation requested"
ACTION_REASON_GIVEN = "Action required by the recipient"

CATEGORY_POINTS = {
    "finance_banking": 10,
    "job_career": 9,
    "healthcare": 9,
    "government_official": 8,
    "work_professional": 7,
    "education": 7,
    "travel": 6,
    "customer_support": 6,
    "events_invitations": 5,
    "social_personal": 4,
    "ecommerce_shopping": 4,
    "notifications": 3,
    "promotions_marketing": 1,
    "other": 3,
}
DEFAULT_CATEGORY_POINTS = 3
CATEGORY_REASONS = {
    "finance_banking": "Financial/banking communication typically requires attention",
    "job_career": "Career-related email carries inherent importance",
    "healthcare": "Medical communication is high-priority by nature",
    "government_official": "Official government communication requires attention",
    "work_professional": "Professional work communication",
    "education": "Academic communication",
    "travel": "Travel-related communication",
    "customer_support": "Customer support communication",
}

EVENT_PATTERNS = [
    r"\b(interview|meeting|appointment|exam|test|presentation|review)\s+(is\s+)?(scheduled|set|confirmed|arranged)\b",
    r"\bscheduled\s+(interview|meeting|appointment)\b",
    r"\b(at|on)\s+\d{1,2}(:\d{2})?\s*(am|pm)\b",
    r"\b(interview|meeting|appointment)\b.{0,60}\b(tomorrow|today|am|pm|\d{1,2}:\d{2})\b",
    r"\b(tomorrow|today)\b.{0,60}\b(interview|meeting|appointment)\b",
]
EVENT_REASON = "Scheduled event (interview/meeting/appointment) detected"
SECURITY_PATTERNS = [
    r"\b(unauthorized|suspicious|fraud|unusual)\s+(activity|access|transaction|login)\b",
    r"\baccount\s+(blocked|suspended|locked|compromised)\b",
    r"\bsecurity\s+alert\b",
    r"\bverif(y|ication)\s+(your\s+)?(identity|account)\b",
    r"\bunauthorized\s+access\b",
    r"\bsuspicious\s+(login|activity)\b",
]
SECURITY_REASON = "Security or fraud alert detected"
TIME_SENSITIVE_PATTERNS = [
    r"\bexpires?\s+(in|on|by|tonight|today|tomorrow)\b",
    r"\bonly\s+\d+\s+(hours?|days?)\s+left\b",
    r"\blast\s+chance\b",
    r"\blimited\s+time\b",
    r"\bdon[''t]t\s+miss\b",
    r"\bfinal\s+(reminder|notice|warning)\b",
    r"\boverdue\b",
]
TIME_SENSITIVE_REASON = "Time-sensitive language detected"
FLAG_POINTS = 10  # event, security and time-sensitive signals
ORGANIZATION_SENDER = r"@(?!gmail|yahoo|hotmail|outlook|proton|icloud)[a-z]+\.(com|org|edu|gov|net|in)\b"
SENDER_POINTS = 5
SENDER_REASON = "Email from an organizational domain"
SCORE_MAX = 100
FACTORS = [
    "urgency_words", "deadline_proximity", "action_required", "category_importance",
    "event_scheduled", "security_alert", "time_sensitive", "sender_importance",
]

# ---------------------------------------------------------------------------
# Entity patterns as (type, pattern, confidence), in output order
# ---------------------------------------------------------------------------
ENTITY_PATTERNS = [
    ("DATE", r"\b(today|tomorrow|yesterday)\b", 0.7),
    ("DATE", r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 0.7),
    ("DATE", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0.7),
    ("DATE", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}(?:st|nd|rd|th)?,? \d{4}\b", 0.7),
    ("TIME", r"\b\d{1,2}:\d{2}\s*(?:am|pm)?\b", 0.7),
    ("TIME", r"\b\d{1,2}\s*(?:am|pm)\b", 0.7),
    ("MONEY", r"\$[\d,]+(?:\.\d{2})?", 0.8),
    ("MONEY", r"₹[\d,]+(?:\.\d{2})?", 0.8),
    ("MONEY", r"£[\d,]+(?:\.\d{2})?", 0.8),
]
ENTITY_TYPES = ["PERSON", "ORG", "DATE", "TIME", "MONEY", "GPE", "EVENT", "CARDINAL", "ORDINAL"]

# Relative deadlines, first match wins
DEADLINE_TWO_DAYS = r"\bin\s+(?:2|two)\s+days?\b"
DEADLINE_48_HOURS = r"\bwithin\s+48\s+hours?\b"
DEADLINE_TOMORROW = r"\btomorrow\b"
DEADLINE_WEEKDAY = r"\b(?:by|before)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# ---------------------------------------------------------------------------
# Requested action in a body, reply templates, reply strategies
# ---------------------------------------------------------------------------
REQUEST_PATTERN = r"\b(?:please|kindly)\s+(send|provide|review|confirm|respond|reply|approve|submit)\s+(.+)"
REQUEST_CUT = r"\s+(?:in|within|by|before)\s+"

REPLY_TEMPLATES = {
    "job_career": (
        "Dear {sender},\n\n"
        "Thank you for reaching out regarding this opportunity. "
        "I appreciate you taking the time to contact me.\n\n"
        "I would be happy to discuss this further and confirm my availability.\n\n"
        "Best regards,\n[Your Name]"
    ),
    "education": (
        "Dear {sender},\n\n"
        "Thank you for the update. I acknowledge receipt of this information "
        "and will act accordingly.\n\n"
        "Please let me know if you require any additional information from my end.\n\n"
        "Regards,\n[Your Name]"
    ),
    "ecommerce_shopping": (
        "Dear {sender},\n\n"
        "Thank you for the update regarding my order. "
        "I have noted the information provided.\n\n"
        "Please let me know if any further action is required from my end.\n\n"
        "Regards,\n[Your Name]"
    ),
    "finance_banking": (
        "Dear {sender},\n\n"
        "Thank you for this notification. I have reviewed the information provided.\n\n"
        "If any action is required from my end, please provide the necessary details "
        "and I will respond promptly.\n\n"
        "Regards,\n[Your Name]"
    ),
    "travel": (
        "Dear {sender},\n\n"
        "Thank you for the travel update. I have noted the details of my booking.\n\n"
        "Please confirm if any action is required from my end.\n\n"
        "Regards,\n[Your Name]"
    ),
    "healthcare": (
        "Dear {sender},\n\n"
        "Thank you for the communication. I acknowledge the appointment/information provided.\n\n"
        "Please let me know if there is anything I need to prepare or confirm.\n\n"
        "Regards,\n[Your Name]"
    ),
}
DEFAULT_TEMPLATE = (
    "Dear {sender},\n\n"
    "Thank you for your email. I have reviewed the information you have shared.\n\n"
    "I will follow up as needed. Please feel free to reach out if you require "
    "any additional information.\n\n"
    "Best regards,\n[Your Name]"
)
UNKNOWN_SENDER = "Sir/Madam"
FOLLOW_UP = "I will follow up as needed."
ACTION_SENTENCE = ("I acknowledge your request to ", " and will review it carefully.")
DEADLINE_SENTENCE = ("I note that the deadline is ", " and will respond accordingly.")

STRATEGIES = {
    "meeting": "MEETING REQUEST: Acknowledge the meeting request, mention only the proposed "
               "date or time available in the email, and confirm, decline, or request clarification.",
    "support": "COMPLAINT/SUPPORT: Acknowledge the issue professionally and state the next step "
               "only when the email provides one.",
    "action": "ACTION REQUEST: Acknowledge the request, confirm the intended action, mention "
              "the deadline when present, and do not claim the task is already completed.",
    "general": "GENERAL/OTHER: Write a concise professional response based on the actual email.",
    "information": "INFORMATION REQUEST: Acknowledge the information being requested without "
                   "inventing missing information.",
}
PERSONAS = {
    "job_career": "You are a professional job seeker or employee writing a career-related email reply. "
                  "Maintain a formal, confident, and enthusiastic tone. Be concise and direct.",
    "work_professional": "You are a professional writing a workplace email reply. "
                         "Use a clear, professional, and collaborative tone. Get to the point efficiently.",
    "education": "You are a student writing a reply to an academic email. "
                 "Use a respectful, polite tone appropriate for communication with professors or institutions.",
    "ecommerce_shopping": "You are a customer writing a reply about an order, delivery, or return. "
                          "Be clear about your order details and politely state your concern or confirmation.",
    "finance_banking": "You are a bank customer replying to a financial or banking email. "
                       "Use a formal, cautious tone. Include relevant account/reference information placeholders. "
                       "Never include real financial credentials in the reply.",
    "travel": "You are a traveler replying to a travel-related email. "
              "Be clear, friendly, and include relevant booking details.",
    "healthcare": "You are a patient or caregiver replying to a healthcare email. "
                  "Use a respectful, clear tone and confirm or politely ask for clarification.",
    "social_personal": "You are writing a warm, friendly personal reply. "
                       "Match the social context — invitation, greeting, or casual message.",
    "events_invitations": "You are replying to an event invitation or registration. "
                          "Be enthusiastic but professional. Confirm or decline clearly.",
    "government_official": "You are writing a formal reply to an official government or legal communication. "
                           "Use very formal language. Include reference numbers where appropriate.",
    "promotions_marketing": "You are replying to a promotional or marketing email. "
                            "Be brief and direct — either acknowledging receipt or requesting more information.",
    "customer_support": "You are a customer writing to support. "
                        "Clearly describe your issue and provide relevant reference numbers.",
    "notifications": "You are acknowledging a notification or automated message. "
                     "Keep the reply brief and confirm receipt if needed.",
    "other": "You are writing a professional email reply. Match the tone of the original email.",
}
TONES = {
    "formal": "Write in a formal, professional tone. Use complete sentences and avoid contractions.",
    "friendly": "Write in a warm, friendly, approachable tone while remaining professional.",
    "concise": "Write a very concise reply — 2–3 sentences maximum. Get to the point immediately.",
    "longer": "Write a comprehensive, detailed reply addressing all points in the original email.",
}
PROMPT_BODY_CHARS = 2000   # the prompt format quotes this much of the body
PROMPT_ENTITIES = 8
PROMPT_INSTRUCTIONS = """INSTRUCTIONS:
1. Write ONLY the reply content — no subject line, no "Subject:" prefix
2. Start with an appropriate greeting
3. Address the main purpose of the email clearly
4. Be {tone} in tone
5. End with a professional sign-off
6. Use [Your Name] as a placeholder for the sender's name
7. Do not invent facts, dates, times, or missing information
8. Do not claim an action was completed unless the email supports that claim
9. Address the actual request and avoid generic phrases such as "I will look into this and get back to you" when a specific action or deadline is available
10. Keep the reply concise
11. Do not include any meta-commentary or explanations — just the reply"""

# fixed sentences: insights, key points, feedback on drafts, lines of the prompt
INSIGHT_ACTION = ("{n} email currently require your response.", "{n} emails currently require your response.")
INSIGHT_HIGH = ("{n} high-priority email is in your inbox.", "{n} high-priority emails are in your inbox.")
INSIGHT_FREQUENT = "'{category}' is your most frequent email category ({share}% of inbox)."
INSIGHT_IMPORTANT = "'{category}' emails have the highest average priority score ({mean}/100)."
INSIGHT_ABOVE = "Your inbox average priority is {mean}/100 — above normal."
INSIGHT_BELOW = "Your inbox average priority is {mean}/100 — mostly low-priority content."
INSIGHT_REPLIES = "AI has generated replies for {rate}% of your analyzed emails."
INSIGHT_NOTHING = "No emails analyzed yet. Add emails to see insights."
POINT_INTENT = "Email intent: "
POINT_DEADLINE = "Key deadline/time: "
POINT_ACTION = "Action is required from the recipient"
POINT_NEGATIVE = "Email carries a negative or urgent tone"
POINT_POSITIVE = "Email has a positive tone"
POINT_ORGANIZATION = "Organization mentioned: "
POINT_PERSON = "Person mentioned: "
FEEDBACK_ACTION = "explicitly acknowledge the requested action: "
FEEDBACK_DEADLINE = "explicitly acknowledge the deadline: "
FEEDBACK_END = ". Do not claim completion."
FEEDBACK_OTHER = "Address the original email specifically."
PROMPT_UNKNOWN_SENDER = "Unknown Sender"
PROMPT_NO_SUBJECT = "(No Subject)"
PROMPT_NO_ACTION = "No specific action was reliably extracted."
PROMPT_DEADLINE = ("\nIMPORTANT: The email mentions a deadline or scheduled time: ", ". Acknowledge this in the reply.")
PROMPT_NAMED = "\nKey information detected: "

# ---- training (fixed values) --------------------------------------------------

#: Candidate name -> (loss, inverse regularization C, balanced classes)
CANDIDATES = {
    "baseline_svc": ("svc", 1.0, False),
    "logistic_regression": ("logistic", 2.0, True),
    "balanced_svc": ("svc", 1.5, True),
}
#: Iterations allowed per loss; training ends earlier once it has converged.
ITERATIONS = {"logistic": 3000, "svc": 5000}
CALIBRATION_FOLDS = 3
