"""sitetide.functions"""
