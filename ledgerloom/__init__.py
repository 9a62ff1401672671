"""ledgerloom: financial-statement standardisation as Spark DataFrame operators.

Every operator takes and returns DataFrames covering many filings at once; nothing is collected to the
driver and no operator depends on partition order.
"""
