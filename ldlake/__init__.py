"""ldlake: summary-statistics genetics on Spark (munging, LD scores, LD-score regression, annotations)."""
