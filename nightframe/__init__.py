"""nightframe: overnight biosignal epochs, features, audits, splits and scoring on Spark."""
