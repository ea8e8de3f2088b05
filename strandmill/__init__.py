"""Analytics over genomic intervals and labelled vectors, as DataFrame operators."""
