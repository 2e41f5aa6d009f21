"""The framework's type hierarchy, roles, simple names of java.lang, and the rules' matching data."""

from __future__ import annotations

# Type, kind (abstract stands for an abstract class), super class, interfaces, and where the row is from.
FRAMEWORK = """
android.accessibilityservice.AccessibilityService | abstract | android.app.Service |  | android-37.0 android.jar
android.app.Activity | class | android.view.ContextThemeWrapper | android.content.ComponentCallbacks2 android.view.KeyEvent.Callback android.view.LayoutInflater.Factory2 android.view.View.OnCreateContextMenuListener android.view.Window.Callback | android-37.0 android.jar
android.app.ActivityGroup | class | android.app.Activity |  | android-37.0 android.jar
android.app.AliasActivity | class | android.app.Activity |  | android-37.0 android.jar
android.app.Application | class | android.content.ContextWrapper | android.content.ComponentCallbacks2 | android-37.0 android.jar
android.app.DialogFragment | class | android.app.Fragment | android.content.DialogInterface.OnCancelListener android.content.DialogInterface.OnDismissListener | android-37.0 android.jar
android.app.ExpandableListActivity | class | android.app.Activity | android.widget.ExpandableListView.OnChildClickListener android.widget.ExpandableListView.OnGroupCollapseListener android.widget.ExpandableListView.OnGroupExpandListener android.view.View.OnCreateContextMenuListener | android-37.0 android.jar
android.app.Fragment | class |  | android.content.ComponentCallbacks2 android.view.View.OnCreateContextMenuListener | android-37.0 android.jar
android.app.IntentService | abstract | android.app.Service |  | android-37.0 android.jar
android.app.LauncherActivity | abstract | android.app.ListActivity |  | android-37.0 android.jar
android.app.ListActivity | class | android.app.Activity |  | android-37.0 android.jar
android.app.ListFragment | class | android.app.Fragment |  | android-37.0 android.jar
android.app.NativeActivity | class | android.app.Activity | android.view.InputQueue.Callback android.view.SurfaceHolder.Callback2 android.view.ViewTreeObserver.OnGlobalLayoutListener | android-37.0 android.jar
android.app.Service | abstract | android.content.ContextWrapper | android.content.ComponentCallbacks2 | android-37.0 android.jar
android.app.TabActivity | class | android.app.ActivityGroup |  | android-37.0 android.jar
android.app.admin.DeviceAdminReceiver | class | android.content.BroadcastReceiver |  | android-37.0 android.jar
android.app.admin.DeviceAdminService | class | android.app.Service |  | android-37.0 android.jar
android.app.job.JobService | abstract | android.app.Service |  | android-37.0 android.jar
android.appwidget.AppWidgetProvider | class | android.content.BroadcastReceiver |  | android-37.0 android.jar
android.content.BroadcastReceiver | abstract |  |  | android-37.0 android.jar
android.content.ContentProvider | abstract |  | android.content.ComponentCallbacks2 | android-37.0 android.jar
android.content.Context | abstract |  |  | android-37.0 android.jar
android.content.ContextWrapper | class | android.content.Context |  | android-37.0 android.jar
android.content.SearchRecentSuggestionsProvider | class | android.content.ContentProvider |  | android-37.0 android.jar
android.inputmethodservice.AbstractInputMethodService | abstract | android.app.Service | android.view.KeyEvent.Callback | android-37.0 android.jar
android.inputmethodservice.InputMethodService | class | android.inputmethodservice.AbstractInputMethodService |  | android-37.0 android.jar
android.net.SSLCertificateSocketFactory | class | javax.net.ssl.SSLSocketFactory |  | android-37.0 android.jar
android.net.VpnService | class | android.app.Service |  | android-37.0 android.jar
android.nfc.cardemulation.HostApduService | abstract | android.app.Service |  | android-37.0 android.jar
android.os.AsyncTask | abstract |  |  | android-37.0 android.jar
android.os.Parcelable | interface |  |  | android-37.0 android.jar
android.preference.PreferenceActivity | abstract | android.app.ListActivity | android.preference.PreferenceFragment.OnPreferenceStartFragmentCallback | android-37.0 android.jar
android.preference.PreferenceFragment | abstract | android.app.Fragment |  | android-37.0 android.jar
android.provider.DocumentsProvider | abstract | android.content.ContentProvider |  | android-37.0 android.jar
android.service.autofill.AutofillService | abstract | android.app.Service |  | android-37.0 android.jar
android.service.dreams.DreamService | class | android.app.Service | android.view.Window.Callback | android-37.0 android.jar
android.service.notification.NotificationListenerService | abstract | android.app.Service |  | android-37.0 android.jar
android.service.quicksettings.TileService | class | android.app.Service |  | android-37.0 android.jar
android.service.wallpaper.WallpaperService | abstract | android.app.Service |  | android-37.0 android.jar
android.support.v4.app.DialogFragment | class | android.support.v4.app.Fragment | android.content.DialogInterface.OnCancelListener android.content.DialogInterface.OnDismissListener | com.android.support:support-fragment:28.0.0
android.support.v4.app.Fragment | class |  | android.content.ComponentCallbacks android.view.View.OnCreateContextMenuListener android.arch.lifecycle.LifecycleOwner android.arch.lifecycle.ViewModelStoreOwner | com.android.support:support-fragment:28.0.0
android.support.v4.app.FragmentActivity | class | android.support.v4.app.SupportActivity | android.arch.lifecycle.ViewModelStoreOwner android.support.v4.app.ActivityCompat.OnRequestPermissionsResultCallback android.support.v4.app.ActivityCompat.RequestPermissionsRequestCodeValidator | com.android.support:support-fragment:28.0.0
android.support.v4.app.JobIntentService | abstract | android.app.Service |  | com.android.support:support-compat:28.0.0
android.support.v4.app.ListFragment | class | android.support.v4.app.Fragment |  | com.android.support:support-fragment:28.0.0
android.support.v4.app.SupportActivity | class | android.app.Activity | android.arch.lifecycle.LifecycleOwner android.support.v4.view.KeyEventDispatcher.Component | com.android.support:support-compat:28.0.0
android.support.v4.content.FileProvider | class | android.content.ContentProvider |  | com.android.support:support-compat:28.0.0
android.support.v4.content.WakefulBroadcastReceiver | abstract | android.content.BroadcastReceiver |  | com.android.support:support-core-utils:28.0.0
android.support.v7.app.AppCompatActivity | class | android.support.v4.app.FragmentActivity | android.support.v7.app.AppCompatCallback android.support.v4.app.TaskStackBuilder.SupportParentable android.support.v7.app.ActionBarDrawerToggle.DelegateProvider | com.android.support:appcompat-v7:28.0.0
android.support.v7.app.AppCompatDialogFragment | class | android.support.v4.app.DialogFragment |  | com.android.support:appcompat-v7:28.0.0
android.view.ContextThemeWrapper | class | android.content.ContextWrapper |  | android-37.0 android.jar
android.webkit.WebChromeClient | class |  |  | android-37.0 android.jar
android.webkit.WebViewClient | class |  |  | android-37.0 android.jar
android.widget.RemoteViewsService | abstract | android.app.Service |  | android-37.0 android.jar
androidx.activity.ComponentActivity | class | androidx.core.app.ComponentActivity | androidx.activity.contextaware.ContextAware androidx.lifecycle.LifecycleOwner androidx.lifecycle.ViewModelStoreOwner androidx.lifecycle.HasDefaultViewModelProviderFactory androidx.savedstate.SavedStateRegistryOwner androidx.activity.OnBackPressedDispatcherOwner androidx.activity.result.ActivityResultRegistryOwner androidx.activity.result.ActivityResultCaller androidx.core.content.OnConfigurationChangedProvider androidx.core.content.OnTrimMemoryProvider androidx.core.app.OnNewIntentProvider androidx.core.app.OnMultiWindowModeChangedProvider androidx.core.app.OnPictureInPictureModeChangedProvider androidx.core.app.OnUserLeaveHintProvider androidx.core.view.MenuHost androidx.activity.FullyDrawnReporterOwner | androidx.activity:activity:1.9.3
androidx.appcompat.app.AppCompatActivity | class | androidx.fragment.app.FragmentActivity | androidx.appcompat.app.AppCompatCallback androidx.core.app.TaskStackBuilder.SupportParentable androidx.appcompat.app.ActionBarDrawerToggle.DelegateProvider | androidx.appcompat:appcompat:1.7.0
androidx.appcompat.app.AppCompatDialogFragment | class | androidx.fragment.app.DialogFragment |  | androidx.appcompat:appcompat:1.7.0
androidx.core.app.ComponentActivity | class | android.app.Activity | androidx.lifecycle.LifecycleOwner androidx.core.view.KeyEventDispatcher.Component | androidx.core:core:1.13.1
androidx.core.app.JobIntentService | abstract | android.app.Service |  | androidx.core:core:1.13.1
androidx.core.content.FileProvider | class | android.content.ContentProvider |  | androidx.core:core:1.13.1
androidx.fragment.app.DialogFragment | class | androidx.fragment.app.Fragment | android.content.DialogInterface.OnCancelListener android.content.DialogInterface.OnDismissListener | androidx.fragment:fragment:1.8.5
androidx.fragment.app.Fragment | class |  | android.content.ComponentCallbacks android.view.View.OnCreateContextMenuListener androidx.lifecycle.LifecycleOwner androidx.lifecycle.ViewModelStoreOwner androidx.lifecycle.HasDefaultViewModelProviderFactory androidx.savedstate.SavedStateRegistryOwner androidx.activity.result.ActivityResultCaller | androidx.fragment:fragment:1.8.5
androidx.fragment.app.FragmentActivity | class | androidx.activity.ComponentActivity | androidx.core.app.ActivityCompat.OnRequestPermissionsResultCallback androidx.core.app.ActivityCompat.RequestPermissionsRequestCodeValidator | androidx.fragment:fragment:1.8.5
androidx.fragment.app.ListFragment | class | androidx.fragment.app.Fragment |  | androidx.fragment:fragment:1.8.5
androidx.legacy.content.WakefulBroadcastReceiver | abstract | android.content.BroadcastReceiver |  | androidx.legacy:legacy-support-core-utils:1.0.0
androidx.lifecycle.LifecycleService | class | android.app.Service | androidx.lifecycle.LifecycleOwner | androidx.lifecycle:lifecycle-service:2.8.7
androidx.multidex.MultiDexApplication | class | android.app.Application |  | androidx.multidex:multidex:2.0.1
com.google.firebase.messaging.EnhancedIntentService | abstract | android.app.Service |  | com.google.firebase:firebase-messaging:24.1.0
com.google.firebase.messaging.FirebaseMessagingService | class | com.google.firebase.messaging.EnhancedIntentService |  | com.google.firebase:firebase-messaging:24.1.0
java.io.Externalizable | interface |  | java.io.Serializable | android-37.0 android.jar
java.io.Serializable | interface |  |  | android-37.0 android.jar
javax.net.SocketFactory | abstract |  |  | android-37.0 android.jar
javax.net.ssl.HostnameVerifier | interface |  |  | android-37.0 android.jar
javax.net.ssl.SSLSocketFactory | abstract | javax.net.SocketFactory |  | android-37.0 android.jar
javax.net.ssl.TrustManager | interface |  |  | android-37.0 android.jar
javax.net.ssl.X509ExtendedTrustManager | abstract |  | javax.net.ssl.X509TrustManager | android-37.0 android.jar
javax.net.ssl.X509TrustManager | interface |  | javax.net.ssl.TrustManager | android-37.0 android.jar
"""

# Role, label, the types that define it.
ROLES = """
activity | Activity | android.app.Activity
service | Service | android.app.Service
receiver | Receiver | android.content.BroadcastReceiver
provider | Provider | android.content.ContentProvider
application | Application | android.app.Application
fragment | Fragment | android.app.Fragment androidx.fragment.app.Fragment android.support.v4.app.Fragment
trust_manager | TrustManager | javax.net.ssl.TrustManager
hostname_verifier | HostnameVerifier | javax.net.ssl.HostnameVerifier
webview_client | WebViewClient | android.webkit.WebViewClient
webchrome_client | WebChromeClient | android.webkit.WebChromeClient
ssl_socket_factory | SSLSocketFactory | javax.net.ssl.SSLSocketFactory
async_task | AsyncTask | android.os.AsyncTask
parcelable | Parcelable | android.os.Parcelable
serializable | Serializable | java.io.Serializable
"""

# Types of java.lang.
JAVA_LANG = """
AbstractMethodError Appendable ArithmeticException ArrayIndexOutOfBoundsException ArrayStoreException AssertionError AutoCloseable Boolean
BootstrapMethodError Byte CharSequence Character Class ClassCastException ClassCircularityError ClassFormatError ClassLoader ClassNotFoundException
ClassValue CloneNotSupportedException Cloneable Comparable Compiler Deprecated Double Enum EnumConstantNotPresentException Error Exception
ExceptionInInitializerError Float FunctionalInterface IllegalAccessError IllegalAccessException IllegalArgumentException IllegalCallerException
IllegalMonitorStateException IllegalStateException IllegalThreadStateException IncompatibleClassChangeError IndexOutOfBoundsException
InheritableThreadLocal InstantiationError InstantiationException Integer InternalError InterruptedException Iterable LinkageError Long MatchException
Math NegativeArraySizeException NoClassDefFoundError NoSuchFieldError NoSuchFieldException NoSuchMethodError NoSuchMethodException
NullPointerException Number NumberFormatException Object OutOfMemoryError Override Package Process ProcessBuilder Readable Record
ReflectiveOperationException Runnable Runtime RuntimeException RuntimePermission SafeVarargs SecurityException SecurityManager Short
StackOverflowError StackTraceElement StackWalker StrictMath String StringBuffer StringBuilder StringIndexOutOfBoundsException SuppressWarnings System
Thread ThreadDeath ThreadGroup ThreadLocal Throwable TypeNotPresentException UnknownError UnsatisfiedLinkError UnsupportedClassVersionError
UnsupportedOperationException VerifyError VirtualMachineError Void WrongThreadException
"""

# What each rule matches.
RULES = [
    {"id": "crypto-ecb-mode", "title": "Cipher in ECB mode (explicit or implicit)", "severity": "medium", "category": "crypto", "kind": "call", "types": ["javax.crypto.Cipher"], "methods": ["getInstance"], "args": [{"index": 0, "regex": "(?i)^(AES|DES|DESede|Blowfish)$|/ECB/"}], "importHints": ["javax.crypto.Cipher"]},
    {"id": "crypto-weak-cipher", "title": "Weak cipher algorithm (DES, 3DES, RC4, RC2)", "severity": "medium", "category": "crypto", "kind": "call", "types": ["javax.crypto.Cipher"], "methods": ["getInstance"], "args": [{"index": 0, "regex": "(?i)^(DES|DESede|TripleDES|RC4|ARCFOUR|RC2)(/|$)"}], "importHints": ["javax.crypto.Cipher"]},
    {"id": "crypto-weak-hash", "title": "Weak hash (MD5, SHA-1)", "severity": "low", "category": "crypto", "kind": "call", "types": ["java.security.MessageDigest"], "methods": ["getInstance"], "args": [{"index": 0, "regex": "(?i)^(MD2|MD4|MD5|SHA-?1|SHA)$"}], "importHints": ["java.security.MessageDigest"]},
    {"id": "crypto-hardcoded-key", "title": "Cryptographic key built from a literal value", "severity": "medium", "category": "crypto", "kind": "new", "types": ["javax.crypto.spec.SecretKeySpec"], "args": [{"index": 0, "literalish": True}], "importHints": ["javax.crypto.spec.SecretKeySpec"]},
    {"id": "crypto-hardcoded-iv", "title": "IV built from a literal value", "severity": "medium", "category": "crypto", "kind": "new", "types": ["javax.crypto.spec.IvParameterSpec"], "args": [{"index": 0, "literalish": True}], "importHints": ["javax.crypto.spec.IvParameterSpec"]},
    {"id": "crypto-fixed-seed", "title": "SecureRandom with a fixed seed", "severity": "medium", "category": "crypto", "kind": "new", "types": ["java.security.SecureRandom"], "argCount": 1, "args": [{"index": 0, "literalish": True}], "importHints": ["java.security.SecureRandom"]},
    {"id": "exec-runtime", "title": "Command execution with Runtime.exec", "severity": "medium", "category": "execution", "kind": "call", "types": ["java.lang.Runtime"], "methods": ["exec"], "returnTypes": {"getRuntime": "java.lang.Runtime"}, "importHints": []},
    {"id": "exec-process-builder", "title": "ProcessBuilder creation", "severity": "low", "category": "execution", "kind": "new", "types": ["java.lang.ProcessBuilder"], "importHints": []},
    {"id": "exec-dynamic-code-loading", "title": "Dynamic code loading (DexClassLoader)", "severity": "medium", "category": "execution", "kind": "new", "types": ["dalvik.system.DexClassLoader", "dalvik.system.PathClassLoader", "dalvik.system.InMemoryDexClassLoader"], "importHints": ["dalvik.system.DexClassLoader", "dalvik.system.PathClassLoader", "dalvik.system.InMemoryDexClassLoader"]},
    {"id": "exec-reflection", "title": "Reflection (Class.forName / Method.invoke)", "severity": "info", "category": "execution", "kind": "call", "types": ["java.lang.Class", "java.lang.reflect.Method"], "methods": ["forName", "invoke"], "importHints": ["java.lang.reflect.Method"]},
    {"id": "storage-world-mode-constant", "title": "MODE_WORLD_READABLE / MODE_WORLD_WRITEABLE", "severity": "medium", "category": "storage", "kind": "identifier", "names": ["MODE_WORLD_READABLE", "MODE_WORLD_WRITEABLE"]},
    {"id": "storage-world-mode-literal", "title": "World-accessible file mode (literal 1, 2 or 3)", "severity": "medium", "category": "storage", "kind": "call", "types": ["android.content.Context"], "methods": ["openFileOutput", "getSharedPreferences", "openOrCreateDatabase", "getDir"], "args": [{"index": 1, "in": [1, 2, 3]}], "importHints": []},
    {"id": "sql-concatenation", "title": "SQL built by concatenation", "severity": "medium", "category": "storage", "kind": "call", "types": ["android.database.sqlite.SQLiteDatabase"], "methods": ["rawQuery", "execSQL"], "args": [{"index": 0, "concat": True}], "importHints": ["android.database.sqlite.SQLiteDatabase"]},
    {"id": "pendingintent-mutable", "title": "PendingIntent without FLAG_IMMUTABLE", "severity": "medium", "category": "platform", "kind": "call", "types": ["android.app.PendingIntent"], "methods": ["getActivity", "getService", "getBroadcast", "getForegroundService", "getActivities"], "argCount": 4, "args": [{"index": 3, "flagsWithout": 67108864, "flagName": "FLAG_IMMUTABLE"}], "importHints": ["android.app.PendingIntent"]},
    {"id": "broadcast-without-permission", "title": "sendBroadcast without a permission", "severity": "info", "category": "platform", "kind": "call", "types": ["android.content.Context"], "methods": ["sendBroadcast"], "argCount": 1, "importHints": []},
    {"id": "untrusted-intent-input", "title": "Reading Intent data in an exported component", "severity": "info", "category": "platform", "kind": "call", "types": ["android.content.Intent"], "methods": ["getData", "getDataString", "getExtras", "getStringExtra", "getIntExtra", "getBooleanExtra", "getParcelableExtra", "getSerializableExtra", "getBundleExtra", "getStringArrayExtra", "getStringArrayListExtra", "getCharSequenceExtra", "getByteArrayExtra"], "returnTypes": {"getIntent": "android.content.Intent"}, "context": "exportedComponent", "importHints": ["android.content.Intent"]},
    {"id": "tls-trustmanager-accepts-all", "title": "TrustManager that does not validate certificates", "severity": "high", "category": "network", "kind": "override", "roles": ["trust_manager"], "methods": ["checkServerTrusted"], "body": "empty"},
    {"id": "tls-hostname-verifier-accepts-all", "title": "HostnameVerifier that always returns true", "severity": "high", "category": "network", "kind": "override", "roles": ["hostname_verifier"], "methods": ["verify"], "body": "returns-true"},
    {"id": "tls-webview-ssl-error-proceed", "title": "onReceivedSslError calls proceed()", "severity": "high", "category": "network", "kind": "override", "roles": ["webview_client"], "methods": ["onReceivedSslError"], "calls": ["proceed"]},
    {"id": "tls-legacy-protocol", "title": "SSLContext with a legacy protocol", "severity": "medium", "category": "network", "kind": "call", "types": ["javax.net.ssl.SSLContext"], "methods": ["getInstance"], "args": [{"index": 0, "in": ["SSL", "SSLv2", "SSLv3", "TLSv1", "TLSv1.1"], "ignoreCase": True}], "importHints": ["javax.net.ssl.SSLContext"]},
    {"id": "webview-javascript-enabled", "title": "JavaScript enabled in a WebView", "severity": "medium", "category": "platform", "kind": "call", "types": ["android.webkit.WebSettings"], "methods": ["setJavaScriptEnabled"], "args": [{"index": 0, "equals": True}], "returnTypes": {"getSettings": "android.webkit.WebSettings"}, "importHints": ["android.webkit.WebView", "android.webkit.WebSettings"]},
    {"id": "webview-javascript-interface", "title": "addJavascriptInterface native bridge", "severity": "medium", "category": "platform", "kind": "call", "types": ["android.webkit.WebView"], "methods": ["addJavascriptInterface"], "argCount": 2, "importHints": ["android.webkit.WebView"]},
    {"id": "webview-file-access", "title": "File access enabled in a WebView", "severity": "medium", "category": "platform", "kind": "call", "types": ["android.webkit.WebSettings"], "methods": ["setAllowFileAccess"], "args": [{"index": 0, "equals": True}], "returnTypes": {"getSettings": "android.webkit.WebSettings"}, "importHints": ["android.webkit.WebView", "android.webkit.WebSettings"]},
    {"id": "webview-file-access-from-file-urls", "title": "setAllowFileAccessFromFileURLs(true)", "severity": "high", "category": "platform", "kind": "call", "types": ["android.webkit.WebSettings"], "methods": ["setAllowFileAccessFromFileURLs"], "args": [{"index": 0, "equals": True}], "returnTypes": {"getSettings": "android.webkit.WebSettings"}, "importHints": ["android.webkit.WebView", "android.webkit.WebSettings"]},
    {"id": "webview-universal-access-from-file-urls", "title": "setAllowUniversalAccessFromFileURLs(true)", "severity": "high", "category": "platform", "kind": "call", "types": ["android.webkit.WebSettings"], "methods": ["setAllowUniversalAccessFromFileURLs"], "args": [{"index": 0, "equals": True}], "returnTypes": {"getSettings": "android.webkit.WebSettings"}, "importHints": ["android.webkit.WebView", "android.webkit.WebSettings"]},
    {"id": "webview-debugging-enabled", "title": "WebView debugging enabled", "severity": "medium", "category": "platform", "kind": "call", "types": ["android.webkit.WebView"], "methods": ["setWebContentsDebuggingEnabled"], "args": [{"index": 0, "equals": True}], "importHints": ["android.webkit.WebView"]},
    {"id": "webview-loadurl-dynamic", "title": "loadUrl with a non-literal argument", "severity": "low", "category": "platform", "kind": "call", "types": ["android.webkit.WebView"], "methods": ["loadUrl"], "args": [{"index": 0, "notLiteral": True}], "importHints": ["android.webkit.WebView"]},
]
