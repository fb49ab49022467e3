"""Training-data operators: ten dataset operators over a `documents` table.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
