"""Four short policy texts of our own and the questions asked about them."""

from __future__ import annotations

# The facts (thresholds, days, hours, formula, roles) that answers must contain.
POLICIES = {
    "Refund_and_Credit_Policy.md": """# Refund and credit policy

## Who may approve a refund
A refund or credit note below $5,000 may be signed off by the customer operations lead.
Refunds above the dollar threshold of $5,000 need executive approval in writing from the VP of Operations.

## Filing a claim
Customers report damage or shortages within 14 days of delivery.
""",
    "Accounts_Receivable_SOP.md": """# Accounts receivable procedure

## Escalation of overdue invoices
Invoices are due after 30 days. Reminders follow a grace period of five business days.
When an invoice is 30 days overdue the customer account is placed on Credit Hold and shipments stop.

## Override of a Credit Hold
The authority to approve an override and release shipments on Credit Hold lies with the Chief Financial Officer.
""",
    "Customer_Support_SLA_Policy.md": """# Customer support service levels

## Response and resolution targets
Critical priority tickets get a first answer in 30 minutes; the target resolution time is 4 hours.
High priority tickets are resolved within 24 hours and medium priority tickets within 48 hours.
""",
    "Inventory_Reorder_and_Safety_Stock_Guidelines.md": """# Warehouse inventory guidelines

## How safety stock is calculated
Safety stock formula: maximum daily usage times maximum lead time minus average daily usage times average lead time.

## Reorder trigger
A purchase order is drafted when the quantity on hand reaches the reorder level.
""",
}

QUESTIONS = {
    "refund_threshold": "What is the dollar threshold for refunds requiring executive approval?",
    "credit_hold_timeline": "When is a customer account placed on Credit Hold for overdue invoices?",
    "critical_ticket_sla": "What is the target resolution time for Critical priority customer tickets?",
    "safety_stock_formula": "How is warehouse safety stock formula calculated?",
    "credit_hold_override": "Who has the authority to approve an override to release shipments on Credit Hold?",
}

HYBRID_QUESTIONS = {
    "overdue_accounts": "Which customers have overdue invoices and should be subject to Credit Hold under our AR policy?",
    "large_orders": "What is the policy threshold for refund approvals, and which recent orders have total amount greater than 5000?",
}
