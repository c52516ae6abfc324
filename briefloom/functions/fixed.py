"""Word lists, weights, patterns, headings and wording.

Everything in this module is a constant that results depend on; each table can
be replaced by passing another one to the operator that uses it. No logic here.
"""

# --- clause types: name, weight, default risk, keyword patterns (order matters)
CLAUSE_TYPES = [
    ("rent", 0.85, "medium", [r"\brent\b", r"\bmonthly\s*rent\b", r"\brental\b", r"\blease\s*amount\b"]),
    ("deposit", 0.8, "medium", [r"\bdeposit\b", r"\bsecurity\s*deposit\b", r"\bearnest\s*money\b", r"\badvance\b"]),
    ("indemnity", 1.0, "high", [r"\bindemnif", r"\bhold\s*harmless\b", r"\bsave\s*harmless\b"]),
    ("insurance", 0.7, "medium", [r"\binsurance\b", r"\binsured\b", r"\bpolicy\b", r"\bcoverage\b", r"\bpremium\b"]),
    ("taxes", 0.7, "low", [r"\btax\b", r"\btaxes\b", r"\bstamp\s*duty\b", r"\bgst\b", r"\btds\b"]),
    ("termination", 1.0, "high", [r"\bterminate\b", r"\btermination\b", r"\bcancel\b", r"\brevok", r"\bend\s*this\s*agreement\b"]),
    ("default", 1.0, "high", [r"\bdefault\b", r"\bbreach\b", r"\bfailure\s*to\s*comply\b", r"\bviolation\b"]),
    ("liability", 1.0, "high", [r"\bliable\b", r"\bliability\b", r"\bdamages\b", r"\bresponsible\s*for\b"]),
    ("penalty", 0.95, "high", [r"\bpenalt", r"\bfine\b", r"\bforfeiture\b", r"\bliquidated\s*damages\b"]),
    ("construction_obligation", 0.8, "medium", [r"\bconstruct", r"\bbuild", r"\berect", r"\bcompletion\s*certificate\b", r"\bbuilding\s*plan\b"]),
    ("timeline", 0.7, "medium", [r"\bwithin\s*\d+", r"\bdeadline\b", r"\btime\s*period\b", r"\bcommencement\b", r"\bexpir"]),
    ("approval", 0.6, "low", [r"\bapprov", r"\bpermission\b", r"\bconsent\b", r"\bsanction\b", r"\bclearance\b"]),
    ("maintenance", 0.6, "low", [r"\bmaintenan", r"\brepair\b", r"\bupkeep\b", r"\brestore\b"]),
    ("confidentiality", 0.8, "medium", [r"\bconfidential", r"\bnon.?disclosure\b", r"\bsecrecy\b", r"\bproprietary\b"]),
    ("jurisdiction", 0.7, "low", [r"\bjurisdiction\b", r"\bgoverning\s*law\b", r"\bcourt\b", r"\btribunal\b"]),
    ("arbitration", 0.8, "medium", [r"\barbitrat", r"\bdispute\s*resolution\b", r"\bmediat"]),
    ("assignment", 0.7, "medium", [r"\bassign", r"\btransfer\s*of\s*rights\b", r"\bsublease\b", r"\bsub.?let\b"]),
    ("renewal", 0.6, "low", [r"\brenewal\b", r"\bextension\b", r"\brenew\b", r"\bextend\b"]),
    ("escalation", 0.7, "medium", [r"\bescalat", r"\bincrease\b", r"\brevision\b", r"\bhike\b"]),
    ("payment", 0.8, "medium", [r"\bpay\b", r"\bpayment\b", r"\bfee\b", r"\bconsideration\b", r"\bremunerat"]),
    ("ownership", 0.8, "medium", [r"\bown\b", r"\bownership\b", r"\btitle\b", r"\bvest\b", r"\bproprietary\b", r"\bright\s+to\s+property\b"]),
    ("obligation", 0.4, "low", [r"\bshall\b", r"\bmust\b", r"\bagrees\s*to\b", r"\bundertakes\b", r"\bis\s*required\s*to\b"]),
]
FALLBACK_TYPE = "obligation"
DUTY_WORDS = r"\b(shall|must|liable|penalty|forfeit)\b"
MONEY_WORDS = r"\b(amount|pay|cost|charge|fee|damages)\b"
CRITICAL_TYPES = ["indemnity", "termination", "liability", "penalty", "default", "arbitration", "insurance"]

# --- who must act: display role, subject words, duty words
ROLE_DUTIES = [
    ("Lessor", "lessor|landlord|owner", r"shall|must|agrees|undertakes|is\s*required"),
    ("Lessee", "lessee|tenant|renter", r"shall|must|agrees|undertakes|is\s*required"),
    ("Buyer", "buyer|purchaser", "shall|must|agrees|undertakes"),
    ("Seller", "seller|vendor", "shall|must|agrees|undertakes"),
    ("Employer", "employer|company", "shall|must|agrees|undertakes"),
    ("Employee", "employee|worker", "shall|must|agrees|undertakes"),
    ("Insurer", "insurer", "shall|must|agrees|undertakes"),
    ("Insured", "insured|policyholder", "shall|must|agrees|undertakes"),
    ("Plaintiff", "plaintiff|petitioner", "shall|must|agrees|claims"),
    ("Defendant", "defendant|respondent", "shall|must|agrees|denies"),
]
LEGAL_ROLES = ["lessor", "lessee", "buyer", "seller", "employer", "employee", "lender", "borrower", "licensor",
               "licensee", "plaintiff", "defendant", "insurer", "insured", "policyholder", "petitioner", "respondent"]
INSTITUTION_TERMS = ["municipal corporation", "corporation", "authority", "government", "court", "tribunal",
                     "registry", "registrar", "bank", "department", "board", "commission", "committee", "council",
                     "agency"]
INSTITUTION_EXEMPT_ROLES = ["insurer", "insured"]

# --- splitting one paragraph into single-duty clauses
TRIGGER_PHRASES = [r"shall\s+pay", r"shall\s+indemnify", r"shall\s+insure", r"must\s+complete", r"agrees\s+to",
                   r"liable\s+for", r"may\s+terminate", r"responsible\s+for", r"prohibited\s+from",
                   r"entitled\s+to", r"shall\s+maintain", r"shall\s+obtain", r"shall\s+provide", r"shall\s+comply",
                   r"shall\s+not", r"must\s+pay", r"must\s+obtain", r"must\s+provide", r"shall\s+be\s+liable",
                   r"shall\s+bear", r"shall\s+execute"]
CLAUSE_BOUNDARY = (r"(?<=[.;])\s+(?=[A-Z(0-9])|(?<=\))\s*\n\s*(?=[a-z(0-9])"
                   r"|\n\s*(?=\(?[a-z0-9]+[.)]\s)|(?:\s+(?=\([a-z0-9]+\)\s))")
CONNECTIVES = (r"provided\s+that|subject\s+to|notwithstanding|in\s+the\s+event\s+of|further[,]?\s+the|additionally|"
               r"moreover|however|in\s+addition")
CUT_BEFORE_TRIGGER = [". ", "; ", ", and ", ", or ", ", "]

# --- values quoted in a clause
AMOUNT_PATTERNS = [r"(?:Rs\.?|INR|₹)\s*[\d,]+(?:\.\d+)?(?:\s*(?:lakh|crore|thousand|hundred)s?)?",
                   r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b", r"\b\d+%\b"]
DEADLINE_PATTERNS = [r"within\s+\d+\s+(?:days?|months?|years?|weeks?)", r"\b\d+\s+(?:days?|months?|years?|weeks?)\b",
                     r"(?:before|by|on\s+or\s+before)\s+\d{1,2}[\s/.-]\w+[\s/.-]\d{2,4}",
                     r"(?:commencement|expiry|completion)\s+(?:date|period)"]

# --- wording per clause type; {p} party, {f} " of <amount>", {d} " by <deadline>"
PLAIN_SUMMARIES = {
    "rent": "{p} is required to make regular rent payments{f}{d}. Failure to pay on time may trigger late fees, interest charges, or grounds for termination of the agreement.",
    "deposit": "{p} must provide a security deposit{f} before occupying the premises. This deposit may be applied against unpaid rent or damages at the end of the lease term.",
    "payment": "{p} has financial payment obligations{f}{d}. Non-payment may result in penalties, suspension of services, or legal action under the agreement.",
    "escalation": "The agreement includes provisions for rent or price increases over time{f}. {p} should budget for these escalations to avoid financial shortfalls during the contract period.",
    "taxes": "{p} is responsible for all applicable taxes, levies, and government charges arising from the agreement. Failure to comply with tax obligations may result in fines or regulatory penalties.",
    "indemnity": "{p} is financially responsible for covering losses, legal claims, third-party injuries, and regulatory violations arising from their actions. This indemnity obligation can create significant and potentially unlimited financial exposure{f}.",
    "liability": "{p} bears financial responsibility for losses and damages under this agreement{f}. Liability exposure should be carefully assessed and mitigated through appropriate insurance coverage.",
    "insurance": "{p} must obtain and maintain adequate insurance coverage{f} throughout the agreement term. Lapse in coverage may constitute a breach of contract and create uninsured risk exposure.",
    "penalty": "A financial penalty applies for breach or non-compliance{f}. {p} must ensure all obligations are fulfilled on schedule to avoid these charges.",
    "default": "This clause defines what constitutes a default under the agreement and the consequences that follow. Upon default, the non-breaching party may pursue remedies including termination, damages, or legal proceedings.",
    "termination": "Either party may terminate this agreement under specified conditions{d}. Understanding termination rights is critical to managing exit risk and avoiding liability for early termination.",
    "renewal": "The agreement includes provisions for renewal or extension beyond the initial term. {p} should review renewal conditions{d} to avoid unintended automatic renewals or unfavorable terms.",
    "construction_obligation": "{p} is responsible for undertaking construction, renovation, or property improvements as specified{d}. Failure to complete these obligations on time may result in financial penalties or breach of contract.",
    "timeline": "The agreement imposes specific performance deadlines{d}. Missing these deadlines may trigger penalties, termination rights, or other contractual consequences for {p}.",
    "approval": "Certain actions under this agreement require formal approval from regulatory bodies or the other party before proceeding. Proceeding without required approvals may constitute a breach and expose {p} to legal risk.",
    "maintenance": "{p} is obligated to maintain the property in good condition throughout the agreement term. Neglecting maintenance responsibilities may result in liability for damages and costs at the end of the term.",
    "confidentiality": "The agreement imposes obligations to keep specified information confidential and not disclose it to third parties. Breach of confidentiality may result in injunctive relief, damages, and reputational harm.",
    "jurisdiction": "Disputes under this agreement are governed by the laws of a specified jurisdiction and must be resolved in designated courts. {p} should understand the practical implications of litigating in the specified forum.",
    "arbitration": "Disputes must be resolved through arbitration rather than court litigation. While arbitration can be faster, {p} waives certain procedural rights available in standard court proceedings.",
    "assignment": "The right to transfer or assign obligations under this agreement is restricted. {p} must obtain prior written consent before assigning their rights to a third party.",
    "ownership": "The agreement defines property rights, title, and ownership boundaries for {p}. Any encumbrances or restrictions on ownership should be carefully reviewed before signing.",
    "obligation": "{p} has specific legal responsibilities under this agreement that must be fulfilled as stated. Failure to meet these obligations may give the other party grounds for breach of contract claims.",
}
LEGAL_IMPACTS = {
    "rent": "Non-payment of rent may lead to eviction, penalties, or lease termination.",
    "deposit": "Deposit terms affect financial exposure and refund conditions at agreement end.",
    "indemnity": "Indemnity clauses can create unlimited financial exposure for the obligated party.",
    "insurance": "Failure to maintain required insurance may constitute a breach of the agreement.",
    "taxes": "Tax obligations affect the total cost of compliance under this agreement.",
    "termination": "Termination provisions define exit conditions and potential financial consequences.",
    "default": "Default provisions may trigger penalties, acceleration clauses, or legal proceedings.",
    "liability": "Liability provisions determine financial exposure and risk allocation between parties.",
    "penalty": "Penalties create direct financial consequences for non-compliance.",
    "construction_obligation": "Failure to complete construction within specified timelines may lead to termination.",
    "timeline": "Missing deadlines may result in penalties, default, or loss of rights.",
    "approval": "Proceeding without required approvals may void actions taken under the agreement.",
    "maintenance": "Failure to maintain the property may result in deductions or breach of agreement.",
    "confidentiality": "Breach of confidentiality may result in damages or injunctive relief.",
    "jurisdiction": "Jurisdiction clauses determine which court or law governs disputes.",
    "arbitration": "Arbitration clauses may limit the right to pursue litigation.",
    "assignment": "Assignment restrictions affect the ability to transfer rights or obligations.",
    "renewal": "Renewal terms affect long-term commitment and renegotiation opportunities.",
    "escalation": "Escalation clauses affect future financial obligations.",
    "payment": "Payment obligations create binding financial commitments.",
    "obligation": "These obligations are legally binding and enforceable.",
}
DEFAULT_IMPACT = "This clause creates legally binding obligations."
BASE_TITLES = {
    "rent": "Rent Payment", "deposit": "Security Deposit", "indemnity": "Indemnity Obligation",
    "insurance": "Insurance Requirement", "taxes": "Tax Obligation", "termination": "Termination Right",
    "default": "Default & Breach", "liability": "Liability Limitation", "penalty": "Penalty Clause",
    "construction_obligation": "Construction Deadline", "timeline": "Important Deadline",
    "approval": "Approval Requirement", "maintenance": "Maintenance Obligation",
    "confidentiality": "Confidentiality Clause", "jurisdiction": "Governing Jurisdiction",
    "arbitration": "Arbitration Clause", "assignment": "Assignment Right", "renewal": "Renewal Option",
    "escalation": "Price Escalation", "payment": "Payment Obligation", "ownership": "Property Ownership",
    "obligation": "Legal Obligation",
}
DEFAULT_TITLE = "Legal Provision"
TITLE_RULES = [
    ("payment", "deposit", "Deposit Payment"), ("payment", "advance", "Advance Payment"),
    ("payment", "installment", "Installment Payment"), ("payment", "refund", "Refund Obligation"),
    ("payment", "interest", "Interest Payment"), ("default", "payment", "Payment Default"),
    ("default", "breach", "Breach Consequences"), ("termination", "notice", "Termination Notice"),
    ("termination", "mutual", "Mutual Termination"), ("termination", "default", "Termination for Default"),
    ("insurance", "fire", "Fire Insurance"), ("insurance", "liability", "Liability Insurance"),
    ("insurance", "health", "Health Insurance"), ("timeline", "completion", "Completion Deadline"),
    ("timeline", "delivery", "Delivery Deadline"), ("timeline", "commenc", "Commencement Date"),
    ("penalty", "delay", "Delay Penalty"), ("penalty", "late", "Late Payment Penalty"),
    ("taxes", "stamp", "Stamp Duty"), ("taxes", "gst", "GST Obligation"),
    ("liability", "unlimited", "Unlimited Liability"), ("liability", "cap", "Liability Cap"),
    ("obligation", "confidential", "Confidentiality Obligation"), ("obligation", "deliver", "Delivery Obligation"),
    ("obligation", "report", "Reporting Obligation"), ("rent", "escalat", "Rent Escalation"),
    ("rent", "advance", "Advance Rent"), ("deposit", "refund", "Deposit Refund"),
    ("indemnity", "third", "Third-Party Indemnity"), ("arbitration", "mediat", "Mediation Clause"),
]

# --- briefing groups
CATEGORY_OF_TYPE = {
    "indemnity": "risks", "liability": "risks", "insurance": "risks", "default": "risks", "penalty": "risks",
    "termination": "exit", "renewal": "exit", "rent": "finance", "deposit": "finance", "payment": "finance",
    "escalation": "finance", "taxes": "finance", "timeline": "construction",
    "construction_obligation": "construction", "approval": "construction", "arbitration": "dispute",
    "jurisdiction": "dispute", "confidentiality": "protections", "ownership": "protections",
    "maintenance": "protections", "assignment": "protections", "obligation": "protections",
}
FALLBACK_CATEGORY = "protections"
CATEGORIES = [  # display order, stored label, short label
    ("risks", "⚠️ Liability & Risk Exposure", "Risk"),
    ("finance", "💰 Financial Commitments", "Finance"),
    ("construction", "🏗️ Construction & Completion Obligations", "Construction"),
    ("exit", "🚪 Exit & Termination Rights", "Exit Rights"),
    ("dispute", "⚖️ Dispute Resolution", "Disputes"),
    ("protections", "🛡️ Legal Protections", "Protections"),
]
UNGROUPED_TYPES = ["obligation"]

# --- text cleaning
REPLACED_CHARS = ("\x0c• \r", "    \n")
NOISE_LINES = [r"^\s*page\s+\d+\s*(?:of\s+\d+)?\s*$", r"^\s*(?:digitally|electronically)\s+signed\b.*$",
               r"^\s*this\s+agreement\s+is\s+made\s+on\b.*$"]
ADDRESS_HINT = (r"\b(?:flat|floor|wing|sector|plot|road|street|lane|apartment|building|district|city|state|pin|"
                r"pincode)\b")
ADDRESS_WORDS = ["flat", "floor", "wing", "sector", "plot", "road", "street", "lane", "apartment", "building", "district",
                 "city", "state", "pin"]  # of which one occurs in every address
ADDRESS_MIN_CHARS = 121
IDENTITY_PHRASES = [r"\bson\s+of\b[^,.;:\n]*", r"\bdaughter\s+of\b[^,.;:\n]*", r"\baged\s+about\b[^,.;:\n]*",
                    r"\b(?:residing|resident)\s+at\b[^.;:\n]*", r"\bhereinafter\s+referred\s+to\s+as\b[^.;:\n]*"]
IDENTITY_WORDS = ["son", "daughter", "aged", "residing", "resident", "hereinafter"]  # of which one occurs in every phrase
CURRENCY_STARTS = "rRiIuU$£\u0130-\u20b9"
NUMERIC_NOISE = [r"\b(?:rs\.?|inr|usd|\$|€|£|₹)\s*(?:[,.-]+)\b", r"\b\d[\d,]*[.,]\s*(?=[^\d]|$)"]
HEADING_STARTS = ["article", "section", "clause"]
NUMBERED_CAPS_HEADING = r"\d+(\.\d+)*[.)-]?\s+[A-Z][A-Z0-9\s/(),.-]{2,}"
BRIEF_LABELS = [r"key pattern observed\s*:\s*", r"primary impact areas\s*:\s*"]
BRIEF_DEFAULT_RISK = "Material contractual exposure is identified and requires legal review."

# --- sections
PREAMBLE_TITLE = "General Context"
NAMED_HEADING = r"^(?:Article|Section|Clause|Schedule|Annexure|Appendix)\s+[\dIVX\.\-]+"
NUMBERED_HEADING = r"^(?:[\dIVX]+|[A-Z])\s*[\.\)]\s+[A-Z][a-zA-Z]+(?:\s+[a-zA-Z]+)*"
HEADING_LABEL_PREFIX = r"^\s*(?:article|section|clause|schedule|annexure|appendix)\s+[\divx\.\-\)\(]+\s*[:\-]?\s*"
HEADING_NUMBER_PREFIX = r"^\s*(?:[\divx]+|[a-z])[\.\)]\s*"
NOISE_HEADINGS = [
    "designated account details", "repayment schedule", "execution", "signatures", "signature block", "witness",
    "witnesses", "in witness whereof", "signed and delivered", "general context", "schedule", "annexure",
    "appendix", "table of contents", "contents", "index", "page", "date", "place", "stamp duty", "registration",
    "notarization", "attestation", "declaration", "acknowledgement", "acknowledgment", "verification", "affidavit",
    "power of attorney", "poa", "enclosures", "list of documents", "disclaimer", "note", "notes", "exhibit",
    "exhibits", "format", "form", "proforma",
]
SINGLE_WORD_HEADINGS = [
    "definitions", "recitals", "preamble", "representations", "warranties", "covenants", "indemnification",
    "termination", "confidentiality", "arbitration", "jurisdiction", "miscellaneous", "default", "remedies",
    "insurance", "security", "guarantee", "collateral", "disbursement", "prepayment", "moratorium",
]
HONORIFIC_HEADING = r"^(mr|ms|mrs|dr)\.?\s+"
BLANK_FIELDS = ["name: ____", "address: ____"]
TEMPLATES = {
    "contract": ["Executive Summary", "Parties and Roles", "Key Terms and Duration", "Financial Obligations",
                 "Rights and Responsibilities", "Usage Restrictions and Rules", "Termination Conditions",
                 "Legal Clauses", "Practical Risks and Red Flags",
                 "What Should Be Negotiated or Checked Before Signing"],
    "property": ["Executive Summary", "Parties and Property Details", "Ownership and Possession", "Financial Terms",
                 "Key Obligations and Conditions", "Transfer Process and Timeline",
                 "Restrictions and Encumbrances", "Legal Clauses", "Practical Risks and Red Flags",
                 "What Should Be Verified Before Signing"],
    "court_judgment": ["Facts", "Issues", "Reasoning", "Decision"],
    "insurance": ["Executive Summary", "Policyholder and Insurer Details", "Coverage Details",
                  "Premium and Payment Terms", "Exclusions and Limitations", "Claim Process and Documentation",
                  "Waiting Periods and Conditions", "Legal Clauses", "Practical Risks and Red Flags",
                  "What Should Be Clarified Before Purchase"],
    "financial": ["Executive Summary", "Parties and Financial Product Details", "Key Terms and Conditions",
                  "Financial Obligations", "Rights and Entitlements", "Fees, Charges, and Penalties",
                  "Default and Consequences", "Legal Clauses", "Practical Risks and Red Flags",
                  "What Should Be Understood Before Signing"],
    "general": ["Executive Summary", "Parties Involved", "Key Terms and Conditions", "Financial Obligations",
                "Rights and Responsibilities", "Restrictions and Limitations", "Termination Conditions",
                "Legal Clauses", "Practical Risks and Red Flags", "What Should Be Reviewed Carefully"],
}
OPENING_KEY = "executive_summary"
SECTION_TITLES = {
    "executive_summary": "Executive Summary", "parties": "Parties", "key_terms": "Key Terms",
    "financials": "Financial Obligations", "obligations": "Rights & Obligations", "risks": "Risks & Red Flags",
    "termination": "Termination Conditions",
}
HIDDEN_SECTION = "top_insights"

# --- document types
UPLOAD_TYPES = {
    "contract": "contract", "contracts": "contract", "court_judgment": "court_judgment",
    "court judgment": "court_judgment", "court": "court_judgment", "property": "property",
    "property_agreement": "property", "insurance/financial": "insurance/financial",
    "general_legal_document": "general_legal_document", "general legal document": "general_legal_document",
    "general": "general_legal_document", "rental_contract": "contract", "employment_contract": "contract",
    "rental": "contract", "employment": "contract",
}
ANALYSIS_TYPES = {
    "contract": "contract", "property": "property", "court_judgment": "court_judgment", "insurance": "insurance",
    "financial": "financial", "general": "general", "insurance/financial": "insurance", "rental": "contract",
    "lease": "contract", "employment": "contract", "service": "contract", "general_contract": "contract",
    "sale_deed": "property", "property_agreement": "property", "agreement_to_sell": "property",
    "judgment": "court_judgment", "court_order": "court_judgment", "petition": "court_judgment",
    "appeal": "court_judgment", "policy": "insurance", "health_policy": "insurance", "motor_policy": "insurance",
    "loan": "financial", "financial_agreement": "financial",
}
SUBTYPES = {  # type -> ([(any of these words, subtype)], otherwise)
    "contract": ([(["lease", "rent"], "lease_agreement"), (["employment", "salary"], "employment_contract"),
                  (["service", "deliverable"], "service_agreement")], "general_contract"),
    "property": ([(["sale deed"], "sale_deed"), (["agreement to sell"], "agreement_to_sell"),
                  (["lease", "rent"], "lease_property")], "property_general"),
    "court_judgment": ([(["petition"], "petition_case"), (["appeal"], "appeal_case")], "civil_criminal_judgment"),
    "insurance": ([(["health", "mediclaim"], "health_policy"), (["vehicle", "motor"], "motor_policy")],
                  "general_policy"),
    "financial": ([(["health", "mediclaim"], "health_policy"), (["vehicle", "motor"], "motor_policy")],
                  "general_policy"),
}
CONTRACT_FAMILY = ["contract", "property_agreement", "rental_contract", "employment_contract"]
CONTRACT_SUBTYPE_LABELS = {"rental_contract": "Rental Contract", "employment_contract": "Employment Contract",
                           "property_agreement": "Property Agreement"}
FINAL_STATUSES = ["completed", "analyzed", "processed"]

# --- entities
LABEL_BUCKETS = {"PERSON": "parties", "ORG": "parties", "DATE": "dates", "MONEY": "money", "GPE": "locations",
                 "LOC": "locations", "LAW": "legal_references"}
BUCKETS = ["parties", "money", "dates", "durations", "locations", "legal_references", "case_identifiers",
           "policy_identifiers", "judges"]
ROLES = ["Lessor", "Lessee", "Buyer", "Seller", "Employer", "Employee", "Lender", "Borrower", "Licensor",
         "Licensee", "Disclosing Party", "Receiving Party", "Plaintiff", "Defendant", "Petitioner", "Respondent",
         "Appellant", "Insurer", "Insured", "Policyholder", "Beneficiary"]
GENERIC_WORDS = ["schedule", "lease", "incidental", "agreement", "contract", "parties", "party", "document", "deed",
                 "annexure", "exhibit", "clause", "section"]
MENTION_PREFIXES = ["lessee ", "lessor ", "mr. ", "mrs. ", "ms. ", "the ", "buyer ", "seller ", "plaintiff ",
                    "defendant ", "said ", "above-named "]
ENTITY_PATTERNS = [
    ("legal_references", r"(Section\s\d+[A-Za-z]*\s(?:of\s\w+)?|Act,\s\d{4}|[A-Z][\w\s]+Act)"),
    ("case_identifiers", r"(Case\sNo\.?|Appeal\sNo\.?|Writ\sPetition\s\(C\)\sNo\.?|Suit\sNo\.?)\s?\d+/?\d*"),
    ("policy_identifiers", r"(Policy\sNo\.?|Claim\sID|Certificate\sNo\.?)\s?:?\s?[\w-]+"),
    ("judges", r"(Justice|Hon\.?ble|Judge)\s[A-Z][a-z]+(?:\s[A-Z][a-z]+)*"),
    ("durations", r"\b(\d+\s+(?:years?|months?|days?|weeks?))\b"),
]
# words of which one occurs in every match of a pattern
ENTITY_PATTERN_WORDS = {
    "legal_references": ["section", "act"], "case_identifiers": ["case", "appeal", "writ", "suit"],
    "policy_identifiers": ["policy", "claim", "certificate"], "judges": ["justice", "hon", "judge"],
    "durations": ["year", "month", "day", "week"],
}
LEGAL_PARTY_WORDS = ["act", "section", "article", "rule"]
DATE_HINT = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|20\d{2}|19\d{2})"
DAY_OF = r"(?:st|nd|rd|th)\s+day\s+of\s+"
MONEY_TYPES = ["rent", "deposit", "penalty", "compensation", "premium", "salary", "tax", "damages", "loan amount"]
DUTY_PHRASES = ["shall pay", "must provide", "agrees to", "is responsible for", "shall maintain"]
RISK_PHRASES = ["unlimited liability", "indemnity", "indemnify", "liquidated damages", "termination without cause"]
SUMMARY_PARTY_LINE = (r"^(Lessor|Lessee|Buyer|Seller|Employer|Employee|Lender|Borrower|Licensor|Licensee|Plaintiff|"
                      r"Defendant|Petitioner|Respondent|Insurer|Insured|Policyholder|Beneficiary|Appellant|"
                      r"First Party|Second Party|Party\s*[AB12])\s*[:\-–—]\s*(.+)")
NAME_TITLES = r"^(Mr\.|Mrs\.|Ms\.|Dr\.|Shri|Smt\.?)\s*"

# --- second-pass entity review
REVIEW_GENERIC_WORDS = ["schedule", "lease", "incidental", "agreement", "contract", "parties", "party", "document",
                        "deed"]
REVIEW_PREFIXES = ["lessee ", "lessor ", "mr. ", "mrs. ", "ms. ", "the ", "buyer ", "seller ", "plaintiff ",
                   "defendant "]
REVIEW_MONEY = r"(?:rs\.?|₹|\$|usd|inr)\s*[\d,]+(?:\.\d{1,2})?(?:\s*(?:lakhs?|crores?|k|m|b))?"
REVIEW_DATES = [r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
                r"\b\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b",
                r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"]
# letters and digits that matches of the two begin with, so that most places are passed by at once
REVIEW_MONEY_START = r"(?=[r₹$ui])"
REVIEW_DATE_STARTS = [r"(?=\d)", r"(?=\d)", r"(?=[jfmasond][aepuco][nbrylgptvc])"]
REVIEW_LEGAL = r"(Section\s\d+[A-Za-z]*\s(?:of\s\w+)?|(?:[A-Z][A-Za-z\s]+)\sAct,\s\d{4})"
REVIEW_SECTION = r"(Section\s\d+[A-Za-z]*\s(?:of\s\w+)?)"  # the same for texts without "Act,"
REVIEW_JUDGE = r"(Justice|Hon\.?ble)\s[A-Z][a-z]+\s[A-Z][a-z]+"
REVIEW_CASE = r"(Case\sNo\.?|Appeal\sNo\.?)\s?\d+/?\d*"
REVIEW_POLICY = r"(Policy\sNo\.?|Claim\sID)\s?:?\s?\w+"
REVIEW_ROLES = ["Lessor", "Lessee", "Buyer", "Seller", "Employer", "Employee", "Lender", "Borrower", "Licensor",
                "Licensee", "Disclosing Party", "Receiving Party", "Plaintiff", "Defendant", "Insurer", "Insured",
                "Policyholder"]
REVIEW_NOT_MONEY = ["policy", "case", "claim", "id", "no"]
REVIEW_MONEY_TYPES = ["rent", "penalty", "deposit", "premium", "claim", "compensation"]

# --- questions
GREETING = (r"^\s*(hi|hello|hey|greetings|good\s*(morning|afternoon|evening|day)|thanks|thank\s*you|bye|goodbye|"
            r"howdy|sup|yo|namaste)\s*[!?.]*\s*$")
HELP = (r"(what can you do|help me|how does this work|what are your capabilities|explain features|"
        r"what should i ask|guide me|show me what you can do|how to use|what do you do)")
OFF_TOPIC = (r"(weather|joke|cricket|football|movie|recipe|game|match|song|music|who is the president|capital of|"
             r"population of|how old are you|what is your name|are you a robot|tell me something fun)")
LOOKUP = (r"^\s*(who\s+is|what\s+is|identify|role\s+of|tell\s+me\s+about|info\s+on|details\s+of|who\s+is\s+the|"
          r"what\s+is\s+the)\s+(.+)")
ENTITY_LIST = (r"(who are the parties|list.*(entit|part|names|organizations)|tell.*(entit|part|names)|"
               r"what (organizations?|companies|dates?|locations?|amounts?|money|durations?|judges?|"
               r"legal references|case numbers?|policy numbers?) "
               r"(are|is|were|exist|mentioned|present|listed|found|extracted)|"
               r"show.*(entit|part|names|dates?|locations?|amounts?)|"
               r"list all (parties|entities|names|dates|locations|amounts|organizations)|"
               r"(entities|party names|extracted data|entity names))")
ANALYSIS_WORDS = ["risk", "dangerous", "one-sided", "unfair", "negotiate", "concern", "implication", "ambiguity",
                  "ambiguous", "loophole", "red flag", "problematic", "favorable", "unfavorable", "recommend",
                  "advise", "should i sign", "safe to sign", "protect", "exposure", "liability risk",
                  "summarize liabilities", "what should i", "is this fair", "bias"]
LOOKUP_PREFIX = (r"^(who\s+is\s+the|who\s+is|what\s+is\s+the|what\s+is|identify\s+the|identify|role\s+of\s+the|"
                 r"role\s+of|tell\s+me\s+about\s+the|tell\s+me\s+about|info\s+on\s+the|info\s+on|"
                 r"details\s+of\s+the|details\s+of)\s+")
ROLE_ALIASES = {"landlord": "lessor", "tenant": "lessee", "renter": "lessee", "owner": "lessor",
                "purchaser": "buyer", "vendor": "seller", "claimant": "insured", "insurance company": "insurer",
                "complainant": "plaintiff", "accused": "defendant", "appellant": "appellant", "worker": "employee",
                "company": "employer", "bank": "lender", "debtor": "borrower"}
ORG_ALIASES = {"bbmp": "bruhat bengaluru mahanagara palike", "bda": "bangalore development authority",
               "mcd": "municipal corporation of delhi", "bmc": "brihanmumbai municipal corporation",
               "rera": "real estate regulatory authority", "sebi": "securities and exchange board of india",
               "rbi": "reserve bank of india"}
LOOKUP_BUCKETS = [("parties", "party/individual"), ("money", "financial amount"), ("dates", "date"),
                  ("durations", "duration"), ("locations", "location/jurisdiction"),
                  ("legal_references", "legal reference"), ("case_identifiers", "case identifier"),
                  ("judges", "judge"), ("policy_identifiers", "policy/claim identifier")]

# --- summaries
SCORE_WORDS = ["shall", "must", "agrees", "obligation", "liable", "indemnify", "terminate", "default", "penalty",
               "payment", "rent"]
SECTION_REFERENCE = r"\b(?:Section|Clause|Article)\s+\d+"
CURRENCY = r"(?:Rs\.?|INR|₹|USD|\$)"

# --- risks
RISK_CAPS = {"high": 5, "medium": 5, "low": 3}
RISK_POINTS = {"high": 18, "medium": 10, "low": 4}
TAGS_OF_RISK_TYPE = {
    "liability": ["Liability", "Financial"], "indemnity": ["Liability", "Financial"], "financial": ["Financial"],
    "termination": ["Termination", "Operational"], "compliance": ["Compliance"], "operational": ["Operational"],
    "ambiguity": ["Operational"], "litigation": ["Litigation"], "tax": ["Financial", "Compliance"],
    "insurance": ["Insurance"], "timeline": ["Timeline", "Operational"],
}
DEFAULT_TAGS = ["Operational"]
DIMENSION_WORDS = {
    "financial": ["financial", "payment", "fee", "rent", "tax"], "liability": ["indemnity", "liabilit", "harm"],
    "termination": ["terminat", "cancel", "exit"], "compliance": ["compli", "regulat", "approv", "permit"],
    "operational": ["construct", "deadline", "timeline", "delay"],
}
ALERT_TITLE = "Potential Legal Risk"
ALERT_EXPLANATION = "Potentially problematic contract language detected."
JOB_STATUSES = ["queued", "processing", "completed", "failed"]
