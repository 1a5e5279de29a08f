"""From SQL text to an admitted, analysed plan."""
