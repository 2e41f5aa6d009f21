"""stratalens: DataFrame-native static analysis of application source trees."""
