"""Vocabularies, thresholds and rules, as parameters of the operators."""

from __future__ import annotations

# What right results need to be the same everywhere.
PRIMARY_TYPES = {"income_statement": 100, "statement_of_profit_or_loss": 100, "balance_sheet": 100, "statement_of_financial_position": 100, "cash_flow_statement": 100, "statement_of_cash_flows": 100, "statement_of_changes_in_equity": 95}
REJECT_BELOW, REVIEW_BELOW = 0.50, 0.70
CHUNK_CHARACTERS, CHUNK_OVERLAP, BATCH = 2800, 250, 8
SECTION_WEIGHTS = {"Management Discussion & Analysis": 5.0, "Business Review": 4.5, "Directors Report": 4.0, "CEO Review": 3.5, "Chairman Review": 3.0, "Outlook": 3.0, "Risks": 2.5, "Opportunities": 2.5}
SECTIONS = ["Chairman Review", "CEO Review", "Directors Report", "Management Discussion & Analysis", "Business Review", "Risks", "Opportunities", "Outlook", "Strategy", "Financial Review", "Sustainability", "ESG"]
IGNORED = ["auditor", "independent auditor", "financial statements", "notes to the financial statements", "corporate information", "notice of annual general meeting", "pattern of shareholding", "proxy form"]
KEYWORDS = ["expansion", "capacity", "debt", "borrowings", "exports", "export", "cost", "margin", "working capital", "inventory", "receivables", "payables", "regulatory", "inflation", "exchange rate", "interest rate", "raw material", "energy", "coal", "oil", "freight", "risk", "opportunity", "outlook", "esg", "sustainability"]
GENERIC = ["adequate internal controls", "internal financial controls", "ifrs have been followed", "ifrs, as applicable in pakistan, have been followed", "going concern", "no significant doubts", "corporate governance", "code of conduct", "zero tolerance for non-compliance", "zero-tolerance policy for non-compliance", "no apparent risk or uncertainty"]
QUANTITATIVE = ["%", "rs", "pkr", "usd", "million", "billion", "kwh", "co2", "ton", "tons", "tractor", "tractors", "units", "export", "exports", "revenue", "sales", "profit", "margin", "eps", "debt", "borrowings", "finance cost", "working capital", "cash", "capacity", "production"]
FRAGMENTS = r"\b(?:a nd|ra tio|rat ios|operati ons|ex penditures|activit(?:y|ies)|valu e|re valuation|inv ested|particu lars|j u?ne|employ ee|pro fit|charg es|sale s)\b"
CUT_SHORT = r"\([^)]*$"
CUT_WORD = r"(?i)\b(?:of|and|to|from|for|with|by|in|at|the)$"
RATIO_SOURCE = r"ratio|analysis|return on|percent|percentage|%|times"
DEDUCTIONS = {"critical": 20, "major": 10, "minor": 2}
#: (key, display name, aliases); the registry is a parameter, this one is small.
REGISTRY = [("revenue", "Revenue", ["sales", "net sales", "turnover", "revenue from contracts with customers"]), ("gross_profit", "Gross Profit", ["gross income", "gross earnings"]), ("equity", "Equity", ["total equity", "shareholders equity"]), ("total_assets", "Total Assets", ["assets"])]
SHEETS = {"income_statement": "Income Statement", "balance_sheet": "Balance Sheet", "cash_flow_statement": "Cash Flow Statement", "notes": "Notes"}
#: P10: page types in the order in which they are looked for, the confidence in each, and what a page's heading says then.
PAGE_TYPES = [
    ("proxy", 0.95, ["proxy form", "form of proxy", "notice of annual general meeting", "electronic transmission consent"]),
    ("auditor_report", 0.95, ["independent auditor", "auditor s report", "auditor report", "key audit matter", "basis for opinion"]),
    ("notes", 0.95, ["notes to the unconsolidated financial statements", "notes to the consolidated financial statements", "notes to the financial statements"]),
    ("shareholder", 0.9, ["pattern of shareholding", "shareholding pattern", "shareholders information", "categories of shareholders"]),
    ("governance", 0.85, ["corporate governance", "statement of compliance", "board committees", "audit committee"]),
    ("financial_statement", 0.9, ["statement of financial position", "statement of profit or loss", "statement of comprehensive income", "statement of cash flow", "statement of cash flows", "statement of changes in equity"]),
]
#: P10: what a narrative page's heading says.
NARRATIVE_HEADINGS = ["chairman", "chief executive", "directors are pleased", "directors report", "business review", "management discussion", "management review", "future prospects", "outlook", "sustainability", "principal activities", "performance of company"]
#: O1: what a finding adds to a table's suspicion.
SUSPICIONS = {"missing_years": 20, "missing_labels": 20, "numeric_only_table": 25, "unclassified_table": 10, "no_metric_values": 15}
#: Words that cells split, and what they were; case counts.
SPLIT_WORDS = [
    (r"\bIn\s+vestments\b", "Investments"),
    (r"\bi\s+nvestments\b", "investments"),
    (r"\bHa\s+bib\b", "Habib"),
    (r"\ba\s+ssets\b", "assets"),
    (r"\bshar\s+e\b", "share"),
    (r"\bsubscript\s+ion\b", "subscription"),
    (r"\breserv\s+e\b", "reserve"),
    (r"\breceiva\s+bles\b", "receivables"),
    (r"\btaxatio\s+n\b", "taxation"),
    (r"\bintang\s+ible\b", "intangible"),
    (r"\bpertai\s+ning\b", "pertaining"),
    (r"\bcurren\s+t\b", "current"),
    (r"\bnon[–-]c\s+urrent\b", "non-current"),
    (r"\bgai\s+n\b", "gain"),
    (r"\blo\s+ss\b", "loss"),
    (r"\bobligation\s+s\b", "obligations"),
    (r"\bpers\s+ons\b", "persons"),
    (r"\brem\s+uneration\b", "remuneration"),
    (r"\bexpens\s+es\b", "expenses"),
    (r"\bprepay\s+ments\b", "prepayments"),
]
#: P5: note numbers, ratings and agencies.
NOTE_CELL, RATING_CELL = r"(?i)^(?:[0-9]+(?:\.[0-9]+)+|note\s*[0-9]+(?:\.[0-9]+)*|notes?)$", r"(?i)^(?:A1\+?|A\+?|AA\+?|AAA|BBB\+?|PACRA|VIS|JCR|MOODY|FITCH)$"
#: P20: what in a label or cell keeps the table's scale from a value.
SCALE_EXEMPT = r"%|\b(?:percent(?:age)?|margin|rate|yield|eps|earnings?\s+per\s+share|per\s+share|ratio|times|days|coverage|head\s*count|number\s+of|persons?|employees?|workers?|staff|ordinary\s+shares?|weighted\s+average\s+shares?|shares?\s+outstanding|plant availability|capacity utilization)\b"
SCALE_EXEMPT_COMPACT = ["earningspershare", "earningpershare", "basicanddilutedearningspershare", "cashdividendpershare", "dividendpershare", "bookvaluepershare", "netassetspershare", "pershare"]

# Words that cells split. L2 joins two tokens that make one of these ...
SPLIT_KNOWN = ["addition", "administrative", "advance", "advances", "amenities", "assets", "balances", "bank", "before", "billion", "capital", "cash", "charges", "company", "comprehensive", "cost", "current", "deferred", "deposits", "distribution", "employees", "equipment", "equity", "expenses", "finance", "financial", "gain", "habib", "income", "intangible", "investments", "liabilities", "loans", "loss", "managerial", "noncurrent", "note", "obligations", "of", "operating", "ordinary", "other", "payables", "persons", "prepayments", "profit", "receivables", "remuneration", "reserve", "reserves", "salaries", "share", "subscription", "taxation", "term", "to"]
# ... L3 also one of these; of words of three letters only "and" and "per".
SPLIT_LATER = ["activities", "after", "analysis", "and", "average", "benefit", "coverage", "decrease", "employed", "employee", "earnings", "equivalent", "equivalents", "expenditures", "flow", "generated", "increase", "investment", "june", "operation", "operations", "outflow", "particulars", "per", "plant", "position", "property", "ratio", "ratios", "revaluation", "sale", "sales", "times", "valuation", "value", "year"]
SPLIT_NEVER = ["A", "AA", "AAA", "A1", "A1+", "PACRA", "VIS", "JCR"]
# Fixed values, P4: rows that are no metrics.
NOTE_REFERENCE = r"(?i)^(?:note\s*)?[0-9]+(?:\.[0-9]+)*$"
CONTINUED = r"(?i)\b(?:continued|brought forward|carried forward|same as above|balance b/f|balance c/f|b/f|c/f)\b"
UNIT_NAMED = r"(?i)\b(?:pkr|rs|usd|eur|gbp|rupees?|ruppees|amounts?|thousands?|millions?|mn|billions?|bn)\b|(?:^|[^0-9])[`'’‘]?0{2,3}s?\b|\bin\s+[`'’‘]?0{1,3}"
UNIT_BEGINS = r"(?i)^(?:\(|(?:pkr|rs\.?|rupees?|ruppees|amounts?)\b)"
DISCLOSED = r"(?i)\b(?:managerial remuneration|number of persons|ordinary shares|share counts?|employee counts?|employees?|persons?|shares?)\b"
SUBTOTALS = r"(?i)\b(?:total|subtotal|sub total|net assets|net liabilities|closing balance|opening balance|balance as at|balance at|carrying amount|written down value)\b"
UNIT_WORDS = ["pkr", "rs", "usd", "gbp", "eur", "rupees", "rupee", "ruppees", "amount", "amounts", "thousand", "thousands", "million", "millions", "mn", "billion", "billions", "bn"]
UNIT_FILLERS = ["in", "of", "and", "the", "as", "at"]
# Fixed values, P8, P9, W4: tables whose labels depend on notes, and what such labels and their headers say.
STATEMENT_TYPES = ["balance_sheet", "cash_flow_statement", "comprehensive_income_statement", "income_statement", "profit_and_loss", "statement_of_cash_flows", "statement_of_changes_in_equity", "statement_of_comprehensive_income", "statement_of_financial_position", "statement_of_profit_or_loss"]
NOTE_TYPE_HINTS = ["aging", "borrowings", "capital_work", "cash_and_bank", "contingent", "credit_quality", "debt", "deferred", "deposits", "disclosure", "expense", "expenses", "fair_value", "financial_assets", "financial_instruments", "fixed_assets", "intangible", "inventory", "lease", "liabilities", "loan", "movement", "mutual_fund", "note", "notes", "payables", "prepayments", "provision", "receivables", "related_party", "remuneration", "schedule", "short_term", "stock", "tax", "taxation"]
NOTE_HEADERS = r"\b(?:breakup|claims?|classification|comprises?|details?|during the year|following|in respect of|movement|schedule|set out)\b"
DEPENDENT = [
    ("total_label", r"^(?:total|subtotal|sub total)$"),
    ("generic_note_label", r"^(?:others?|current|non ?current|less than .+|more than .+|neither past due nor impaired)$"),
    ("movement_label", r"^(?:opening balance|closing balance|additions?|disposals?|transfers?|adjustments?|charge for the year|for the year|written off|balance at .+|balance as at .+)$"),
    ("short_disclosure_label", r"^(?:number of persons|number of employees|number of shares|less than pkr .+ each|less than rs .+ each)$"),
]
STANDALONE = ["bank balances", "cash and bank balances", "cash and cash equivalents", "property plant and equipment"]
NEEDS_CONTEXT = r"\b(?:accrued|deposits?|gain|levy|loss|other|prepayments?|receivables?|tax|taxation)\b"
LONE_CONTEXTS = ["taxation", "borrowings"]
# Fixed values, W5: units, sections and headers of tables, and labels that need one.
HEADER_UNITS = r"(?i)\b(?:pkr|rs\.?|usd|rupees?|mn|million|times|percent|mt|each)\b|%"
HEADER_SECTIONS = r"\b(?:assets?|capital|cash flows?|current liabilities|financial ratios|key ratios|liabilities|non ?financial ratios|ratio|share capital|turnover)\b"
HEADER_NAMES = r"\b(?:company|corporation|holdings?|industries|limited|ltd|power|resources|associates?|subsidiar(?:y|ies)|quoted|unquoted)\b"
HEADER_DEPENDENT = r"(?i)^(?:current portion\b.*|investment at cost$|ordinary shares?.*each$|.*\btimes$|.*\bpercent$|.*%.*|.*\brupees?$|.*\bmn$|.*\bmt$)"
HEADER_CUT = r"(?i)(?:\([^)]*$|\b(?:i\s+nc|th\s+e|bas|provi|accumula|unalloca|rema)$|[0-9]+\s*$)"
UNIT_GROUPS = [["percent", "%"], ["rupees", "rupee", "pkr", "rs"], ["times"], ["million", "mn"], ["thousand", "000"], ["each"], ["mt"]]

# Fixed values, D11: words that say nothing of a table's type; and, of a vocabulary that is a parameter, the entries of the main types.
TYPE_STOPS = ["and", "financial", "note", "notes", "of", "schedule", "statement", "table"]
PRIMARY_PROFILES = ["balance_sheet", "cash_flow_statement", "income_statement", "statement_of_changes_in_equity"]
TYPE_PROFILES = {"statement_of_financial_position": "balance_sheet", "statement_of_profit_or_loss": "income_statement", "profit_and_loss": "income_statement", "cash_flow": "cash_flow_statement", "statement_of_cash_flows": "cash_flow_statement", "borrowings_note": "debt_schedule", "loans_and_borrowings": "debt_schedule"}
TYPE_KEYWORDS = {
    "balance_sheet": ["statement of financial position", "total assets", "non current assets", "current assets", "total liabilities", "share capital", "reserves", "equity", "trade receivables", "trade payables", "cash and bank"],
    "income_statement": ["statement of profit or loss", "revenue", "sales", "cost of sales", "gross profit", "operating profit", "finance cost", "profit before tax", "profit after tax", "earnings per share"],
    "cash_flow_statement": ["statement of cash flows", "cash flows", "operating activities", "investing activities", "financing activities", "net cash", "cash and cash equivalents"],
    "debt_schedule": ["debt schedule", "borrowings", "long term debt", "long term financing", "short term borrowings", "lease liabilities", "debt"],
    "notes": ["notes to the financial statements", "for the year ended", "pkr in"],
}
TYPE_SIGNALS = {
    "balance_sheet": ["financial position", "assets employed", "current assets", "non current assets", "current liabilities", "equity and liabilities", "capital and reserves", "share capital", "net assets", "total equity"],
    "income_statement": ["distribution cost", "administrative expenses", "other income", "finance charges", "profit for the year", "gross profit", "operating profit"],
    "cash_flow_statement": ["cash generated from operations", "working capital changes", "operating activities", "investing activities", "financing activities", "cash and cash equivalents"],
    "debt_schedule": ["long term financing", "current portion of long term", "short term borrowings", "lease liabilities", "markup accrued", "repayable"],
}

# Fixed values, N12: types by statement, and the rules as (name, severity, metric and statement that should equal, signed terms).
SCOPES = {
    "balance": ["balance_sheet", "statement_of_financial_position", "financial_position"],
    "income": ["income_statement", "profit_and_loss", "statement_of_profit_or_loss", "statement_of_comprehensive_income"],
    "cash": ["cash_flow", "cash_flow_statement", "statement_of_cash_flows"],
    "equity": ["statement_of_changes_in_equity", "equity", "retained_earnings"],
    "ppe": ["property_plant_equipment_note", "ppe_note", "fixed_assets_note", "property_plant_and_equipment"],
    "debt": ["debt_schedule", "borrowings_note", "loan_note", "financing_note"],
}
SUM_RULES = [
    ("accounting_equation", "critical", "balance:total_assets", "+balance:total_liabilities +balance:total_equity"),
    ("total_assets_breakdown", "major", "balance:total_assets", "+balance:current_assets +balance:non_current_assets"),
    ("current_assets_breakdown", "major", "balance:current_assets", "+balance:cash +balance:inventory +balance:trade_receivables +balance:other_current_assets"),
    ("current_liabilities_breakdown", "major", "balance:current_liabilities", "+balance:trade_payables +balance:short_term_borrowings +balance:current_portion_of_debt +balance:other_current_liabilities"),
    ("total_liabilities_breakdown", "major", "balance:total_liabilities", "+balance:current_liabilities +balance:non_current_liabilities"),
    ("total_equity_breakdown", "major", "balance:total_equity", "+balance:share_capital +balance:reserves +balance:retained_earnings"),
    ("gross_profit_formula", "major", "income:gross_profit", "+income:revenue -income:cost_of_sales"),
    ("operating_profit_formula", "major", "income:operating_profit", "+income:gross_profit -income:operating_expenses"),
    ("ebit_formula", "major", "income:ebit", "+income:operating_profit +income:other_income"),
    ("profit_before_tax_formula", "major", "income:profit_before_tax", "+income:ebit -income:finance_cost"),
    ("profit_after_tax_formula", "major", "income:profit_after_tax", "+income:profit_before_tax -income:tax_expense"),
    ("net_change_in_cash_formula", "major", "cash:net_change_in_cash", "+cash:operating_cash_flow +cash:investing_cash_flow +cash:financing_cash_flow"),
    ("closing_cash_formula", "major", "cash:closing_cash", "+cash:opening_cash +cash:net_change_in_cash"),
    ("cash_consistency", "critical", "balance:cash", "+cash:closing_cash"),
    ("retained_earnings_roll_forward", "major", "equity:ending_retained_earnings", "+equity:beginning_retained_earnings +income:profit_after_tax -equity:dividends"),
    ("ppe_roll_forward", "major", "balance,ppe:ending_ppe", "+balance,ppe:beginning_ppe +ppe:capex -ppe:depreciation"),
    ("debt_roll_forward", "major", "balance,debt:ending_debt", "+balance,debt:beginning_debt +debt:new_borrowings -debt:repayments"),
]
#: A ratio, what it is of, and what by; an empty statement is any.
RATIO_RULES = [("eps_formula", "major", ":eps", "income:profit_after_tax", ":weighted_average_shares"), ("roe_formula", "major", ":roe", "income:profit_after_tax", ":average_equity"), ("current_ratio_formula", "major", ":current_ratio", "balance:current_assets", "balance:current_liabilities")]
CRITICAL_METRICS = ["income:revenue", "income:profit_after_tax", "balance:total_assets", "balance:total_liabilities", "balance:total_equity"]
NOT_NEGATIVE = ["income:revenue", "balance:total_assets", "balance:current_assets", "balance:non_current_assets", "balance:inventory"]
#: Parts that statements must have: a metric, or a label with one of the phrases.
PARTS = [
    ("balance_sheet_assets_section", "balance", ["total_assets", "current_assets", "non_current_assets", "cash"], ["assets", "current assets", "non current assets"]),
    ("balance_sheet_liabilities_section", "balance", ["total_liabilities", "current_liabilities", "non_current_liabilities"], ["liabilities", "current liabilities", "non current liabilities"]),
    ("balance_sheet_equity_section", "balance", ["total_equity", "share_capital", "reserves", "retained_earnings"], ["equity", "share capital", "reserves", "retained earnings"]),
    ("income_statement_revenue_section", "income", ["revenue"], ["revenue", "sales", "turnover"]),
    ("income_statement_expenses_section", "income", ["cost_of_sales", "operating_expenses", "finance_cost", "tax_expense"], ["expense", "expenses", "cost of sales", "finance cost", "tax"]),
    ("income_statement_profit_section", "income", ["gross_profit", "operating_profit", "profit_after_tax"], ["profit", "income", "earnings"]),
    ("cash_flow_operating_section", "cash", ["operating_cash_flow"], ["operating activities", "operating cash flow"]),
    ("cash_flow_investing_section", "cash", ["investing_cash_flow"], ["investing activities", "investing cash flow"]),
    ("cash_flow_financing_section", "cash", ["financing_cash_flow"], ["financing activities", "financing cash flow"]),
]
# Of the labels of metrics, which are a parameter, the first ones of each.
METRIC_LABELS = {
    "total_assets": ["total assets", "assets"], "current_assets": ["current assets", "total current assets"], "non_current_assets": ["non current assets"], "cash": ["cash and bank balances", "cash"], "inventory": ["stock in trade", "inventory"],
    "trade_receivables": ["trade debts", "trade receivables"], "other_current_assets": ["other current assets"], "total_liabilities": ["total liabilities"], "current_liabilities": ["current liabilities"], "non_current_liabilities": ["non current liabilities"],
    "total_equity": ["total equity", "shareholders equity"], "share_capital": ["share capital"], "reserves": ["capital reserves", "reserves"], "retained_earnings": ["retained earnings", "unappropriated profit"], "revenue": ["net sales", "turnover", "revenue"],
    "cost_of_sales": ["cost of sales", "cost of goods sold"], "gross_profit": ["gross profit"], "operating_expenses": ["operating expenses", "administrative expenses"], "operating_profit": ["operating profit", "profit from operations"], "other_income": ["other income"],
    "finance_cost": ["finance cost", "finance costs"], "profit_before_tax": ["profit before taxation", "profit before tax"], "tax_expense": ["taxation", "tax expense"], "profit_after_tax": ["profit after taxation", "profit for the year"],
    "closing_cash": ["cash and cash equivalents at end of year", "closing cash"], "opening_cash": ["cash and cash equivalents at beginning of year", "opening cash"], "ending_retained_earnings": ["unappropriated profit at end of year"], "beginning_retained_earnings": ["unappropriated profit at beginning of year"],
    "other_current_liabilities": ["other current liabilities"], "eps": ["earnings per share", "eps"], "roe": ["return on equity", "roe"], "current_ratio": ["current ratio"],
}

# Fixed values, P11: how headings name the sections.
SECTION_ALIASES = {
    "Chairman Review": ["chairman review", "chairman's review", "chairman statement", "chairman's statement"],
    "CEO Review": ["ceo review", "chief executive review", "chief executive officer review", "ceo message"],
    "Directors Report": ["directors report", "directors' report", "report of the directors"],
    "Management Discussion & Analysis": ["management discussion and analysis", "management discussion & analysis", "md&a", "management review"],
    "Business Review": ["business review", "operating review", "performance review", "business operations", "company overview", "key performance indicators", "segmental review of business performance"],
    "Risks": ["risks and opportunities", "operational risks", "risk factors", "principal risks", "risk management"],
    "Opportunities": ["opportunities", "future opportunities", "growth opportunities"],
    "Outlook": ["outlook", "future outlook", "future prospects", "market outlook"],
    "Strategy": ["strategy", "pestle analysis", "swot analysis", "strategic objectives", "strategy and resource allocation"],
    "Financial Review": ["financial review", "financial performance", "financial results", "financial overview", "key figures", "financial highlights", "dupont analysis"],
    "Sustainability": ["sustainability", "sustainability review", "corporate social responsibility", "csr"],
    "ESG": ["esg", "environmental social and governance", "environment social governance"],
}

# Fixed values, P19: rows and types by which an analysis table is known.
ANALYSIS_PRIMARY = ["balance_sheet", "statement_of_financial_position", "income_statement", "profit_and_loss", "statement_of_profit_or_loss"]
ANALYSIS_SUBTOTALS = ["total assets", "total equity", "total equity and liabilities", "total funds invested", "gross profit", "operating profit", "profit before taxation", "profit after taxation", "total comprehensive income"]

# Fixed values, X1, A12: labels of templates that are no metrics, and metrics that a template must have.
TEMPLATE_WORDS = ["account", "amount", "description", "line_item", "metric", "metrics", "note", "notes", "particular", "particulars", "pkr", "pkrs", "rs", "rupees", "year", "years"]
CRITICAL_TEMPLATE = ["revenue", "gross_profit", "ebitda", "profit_after_tax", "pat", "total_assets", "total_liabilities", "total_equity"]
