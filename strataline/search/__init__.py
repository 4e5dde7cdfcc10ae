"""The search for expressions: proposals, their alignment with a rationale, and the rounds that test them."""
